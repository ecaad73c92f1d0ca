"""Whose contact it is: addresses and links of the platforms themselves against those of the record's own people.

`Platforms` holds the lists that a user supplies (hosts, handles, generic local parts); the rules are expressions.
Cases: null and empty addresses belong to the platform; null arrays are empty; results keep the arrays' order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.contacts import best_contact, clean_emails, clean_links, clean_phones, is_direct_contact
from tamis.functions.text import _col, normalize_space, plain
from tamis.functions.urls import domain_of, host_in, path_parts, safe_url, title_from_url


@dataclass(frozen=True)
class Platforms:
    """Hosts of platforms (with their subdomains), of widgets, of free mail and of mail that is never kept; handles of the
    platforms; a pattern of generic local parts; words that are no one's identity."""

    hosts: list[str]
    widgets: list[str] = field(default_factory=list)
    free_mail: list[str] = field(default_factory=list)
    generic_mail: list[str] = field(default_factory=list)
    handles: list[str] = field(default_factory=list)
    generic_locals: str = r"^(?:info|support|help|admin|noreply)$"
    generic_words: list[str] = field(default_factory=list)


def platform_root(domain: Column | str, platforms: Platforms) -> Column:
    """URL-9: the platform's host that the domain is or is below, else empty."""
    d = F.regexp_replace(F.lower(F.coalesce(_col(domain), F.lit(""))), r"^www\.", "")
    return F.coalesce(*(F.when((d == h) | d.endswith("." + h), F.lit(h)) for h in platforms.hosts), F.lit(""))


def is_profile_url(url: Column | str, platforms: Platforms) -> Column:
    """URL-9: an address on one of the platforms."""
    return platform_root(domain_of(url), platforms) != ""


def handle_of(url: Column | str) -> Column:
    """URL-9: the name that a social address is of: the second path segment on linkedin.com, else the first without @."""
    u = safe_url(url)
    p, d = path_parts(u), domain_of(u)
    linked = (d == "linkedin.com") | d.endswith(".linkedin.com")
    first = F.lower(F.regexp_replace(F.coalesce(F.get(p, F.lit(0)), F.lit("")), "^@", ""))
    return F.when(linked, F.lower(F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0)), F.lit("")))).otherwise(first)


def is_owned_url(url: Column | str, source: Column | str, platforms: Platforms) -> Column:
    """URL-9: no address, one of a widget or a platform, or a platform's own handle elsewhere; `source` is the record's."""
    u = safe_url(url)
    d, handle = domain_of(u), handle_of(url)
    brands = F.array(*map(F.lit, platforms.handles)).cast("array<string>")
    widget = host_in(d, platforms.widgets) if platforms.widgets else F.lit(False)
    own = (handle != "") & (F.array_contains(brands, handle) | (is_profile_url(source, platforms) & F.array_contains(brands, F.regexp_replace(handle, "[^a-z0-9]+", ""))))
    return F.coalesce(u.isNull() | (d == "") | widget | (platform_root(d, platforms) != "") | own, F.lit(True))


def identity_words(text: Column | str, platforms: Platforms) -> Column:
    """ARR-6: the folded words of a record that may stand in its people's addresses."""
    words = F.filter(F.split(plain(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    return F.array_except(words, F.array(*map(F.lit, platforms.generic_words)).cast("array<string>"))


def matches_identity(email: Column, words: Column) -> Column:
    """ARR-6: whether the local part of an address, of five letters or more, holds a word or is held by one."""
    local = F.regexp_replace(F.substring_index(F.lower(email), "@", 1), "[^a-z0-9]+", "")
    return (F.length(local) >= 5) & F.exists(words, lambda w: local.contains(w) | w.contains(local))


def is_owned_email(email: Column, source: Column | str, words: Column, platforms: Platforms) -> Column:
    """ARR-6: no address; generic mail or local part; a platform's mail on a platform's record; free mail on a platform's
    record that doesn't match the record's identity."""
    e = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    local, host = F.substring_index(e, "@", 1), F.regexp_replace(F.when(e.contains("@"), F.substring_index(e, "@", -1)).otherwise(""), r"^www\.", "")
    inside = is_profile_url(source, platforms)
    free = host.isin(platforms.free_mail) if platforms.free_mail else F.lit(False)
    generic = host.isin(platforms.generic_mail) if platforms.generic_mail else F.lit(False)
    return (local == "") | (host == "") | generic | local.rlike(platforms.generic_locals) | ((platform_root(host, platforms) != "") & inside) | (inside & free & ~matches_identity(e, words))


def decision_emails(emails: Column | str, source: Column | str, words: Column, platforms: Platforms, **clean) -> Column:
    """ARR-6: clean addresses that aren't the platform's."""
    return F.filter(clean_emails(emails, **clean), lambda e: ~is_owned_email(e, source, words, platforms))


def decision_links(links: Column | str, platforms: Platforms, **clean) -> Column:
    """ARR-7: clean direct links that aren't on a platform."""
    return F.filter(clean_links(links, allow_channels=False, **clean), lambda u: is_direct_contact(u) & ~is_profile_url(u, platforms))


def has_direct_path(links: Column | str) -> Column:
    """ARR-5: whether some link leads to someone directly."""
    return F.exists(F.coalesce(_col(links), F.array().cast("array<string>")), is_direct_contact)


def bare_websites(text: Column | str) -> Column:
    """ARR-7: addresses that a text gives as www. without a scheme, in normal form."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"""(?i)(?:^|[\s"'(>])(www\.[a-z0-9][a-z0-9.-]+\.[a-z]{2,24}(?:/[^\s"'<>)}\]]*)?)"""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda u: safe_url(F.concat(F.lit("https://"), F.regexp_replace(u, "[.,;]+$", "")))), lambda u: u.isNotNull()))


def maker_links(urls: Column | str, most: int = 8) -> Column:
    """ARR-12: profiles of people and companies on linkedin.com."""

    def good(u: Column) -> Column:
        p, d = path_parts(u), domain_of(u)
        return ((d == "linkedin.com") | d.endswith(".linkedin.com")) & F.lower(F.get(p, F.lit(0))).isin("in", "company") & (F.size(p) >= 2)

    return F.slice(F.filter(clean_links(urls, allow_channels=False), good), 1, most)


def makers(known: Column | str, links: Column | str, most: int = 6) -> Column:
    """ARR-12: known people (array of struct name, title, url) and those that links lead to, one for each address and name."""
    from_links = F.transform(maker_links(links), lambda u: F.struct(title_from_url(u).alias("name"), F.lit("LinkedIn decision-maker/company path").alias("title"), u.alias("url")))
    shaped = F.transform(_col(known), lambda p: F.struct(normalize_space(F.coalesce(F.when(p["name"] != "", p["name"]), F.regexp_extract(F.coalesce(p["title"], F.lit("")), r"^(.*?)(?:\s[-|]\s|$)", 1))).alias("name"), normalize_space(p["title"]).alias("title"), F.coalesce(p["url"], F.lit("")).alias("url")))
    both = F.filter(F.concat(F.coalesce(shaped, F.array().cast("array<struct<name:string,title:string,url:string>>")), from_links), lambda p: (p["name"] != "") | (p["url"] != ""))
    key = lambda p: F.lower(F.concat(p["url"], F.lit("|"), p["name"]))
    keys = F.transform(both, key)
    return F.slice(F.filter(both, lambda p, i: F.array_position(keys, key(p)) == i + 1), 1, most)


def all_urls(*arrays: Column | str) -> Column:
    """SUP-6: the ordered union of single addresses and arrays of them."""
    parts = [F.coalesce(_col(a), F.array().cast("array<string>")) for a in arrays]
    return F.array_distinct(F.filter(F.concat(*parts), lambda u: u != ""))


def forms_summary(forms: Column | str) -> Column:
    """PRJ-10: "page -> action [fields]" of each form."""
    fields = lambda f: F.array_join(f["fields"], "; ")
    return F.transform(_col(forms), lambda f: F.concat(F.coalesce(F.when(f["page_url"] != "", f["page_url"]), f["action"], F.lit("")), F.lit(" -> "), F.coalesce(f["action"], F.lit("")), F.when(fields(f) != "", F.concat(F.lit(" ["), fields(f), F.lit("]"))).otherwise("")))


def people_summary(people: Column | str) -> Column:
    """PRJ-10: "name | title | url" of each person, without what is empty."""
    return F.transform(_col(people), lambda p: F.array_join(F.filter(F.array(p["name"], p["title"], p["url"]), lambda x: x != ""), " | "))


def clean_contacts(leads: DataFrame, platforms: Platforms) -> DataFrame:
    """PRJ-6, SUP-12: a lead's contacts without the platform's: addresses, phones, links and websites cleaned, a best contact
    that is the platform's blanked, and where none is left the best of the rest picked. Columns: url, name, title, emails,
    phones, links, websites, forms (page addresses), best_contact, best_type."""
    words = identity_words(F.concat_ws(" ", "name", "title"), platforms)
    out = leads.withColumns({
        "emails": decision_emails("emails", "url", words, platforms),
        "phones": clean_phones("phones"),
        "links": decision_links("links", platforms),
        "websites": F.filter(clean_links("websites", allow_channels=False), lambda u: ~is_profile_url(u, platforms)),
    })
    owned = F.when(F.col("best_type") == "email", is_owned_email(F.col("best_contact"), "url", words, platforms)).otherwise(is_owned_url("best_contact", "url", platforms))
    keeps = (F.coalesce("best_contact", F.lit("")) != "") & ~F.coalesce(owned & (F.col("best_type") != "phone"), F.lit(True))
    best = best_contact(F.col("emails"), F.col("phones"), F.concat("links", "websites"), F.col("forms"))
    out = out.withColumns({"_keeps": keeps, "_best": best})
    return out.withColumns({"best_contact": F.when(F.col("_keeps"), F.col("best_contact")).otherwise(F.col("_best.contact")), "best_type": F.when(F.col("_keeps"), F.col("best_type")).otherwise(F.col("_best.kind"))}).drop("_keeps", "_best")
