"""Contact arrays: extraction from text, cleaning, ranking. Built-in Spark expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import _col, let, normalize_space
from tamis.functions.urls import domain_of, host_in, is_blocked, is_referral, path_and_query, path_parts, safe_url

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}"
PHONE = r"(?:\+|00)[0-9][0-9 ().-]{8,20}[0-9]"
LINK = r"https?://[^\s<>\"')\]]+"
# Local parts of addresses that nobody reads.
NO_REPLY = r"^(?:no-?reply|donotreply|do-not-reply|noreply)$"
# Local parts of made-up addresses.
PLACEHOLDER = r"^(?:you|your|name|nome|email|mail|test|teste|example|exemplo|joao|john\.?appleseed)$"
# Handles of the platforms themselves and of tools.
BLOCKED_HANDLES = [
    "whatsapp", "whatsappforbusiness", "whatsappbusiness", "meta", "tiktok", "twitter", "x", "linkedin", "instagram", "youtube", "vidiq", "vidiqapp",
    "grammarly", "eventbrite", "eventbritehelp", "paxcapitals", "yapo.cl", "kankyojpn.gov", "superhuman", "jotform", "whop", "whophq", "wordpresscom",
]
# Marks of forms that are no way to write to someone.
FORM_JUNK = r"(?i)login|register|registration|sign[-_ ]?up|signin|shopping[_-]?cart|domain[_-]?search|password|promo[_-]?code|checkout"
# Words of a contact form, and fields of a message form.
FORM_INTENT = r"contact|contacto|contato|partner|partnership|affiliate|afiliado|book|call|message|mensagem|mensaje"
FORM_MESSAGE = r"message|mensagem|mensaje|comment|subject|phone|telefone|whatsapp"
FORM_SENDER = r"email|name|nome|nombre|phone|telefone|whatsapp"


def extract_all(text: Column | str, pattern: str) -> Column:
    """EXT-2..4: all matches in order, first occurrences only."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"({pattern})"), F.lit(1)))


# Patterns of addresses, local parts and hosts that are no one's mail.
BAD_EMAIL = r"u00|\\u|%[0-9a-f]{2}|example\.|email@|domain\.|\.(?:png|jpe?g|gif|webp|svg)$"
BAD_LOCAL = r"^n?email-|^\d{2,}|\.(?:com|net|org)|^[a-f0-9]{24,}$|instagraminstagram|facebookfacebook|youtubeyoutube|socials"
BAD_MAIL_HOST = r"\.(?:com|net|org|co|io|ai|br|mx|es|pt|in|uk)[a-z]{2,}|\.(?:method|nelson)$"
GOOD_EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}$"


def clean_emails(emails: Column | str, blocked: list[str] = (), most: int = 8, broker_hosts: list[str] = ()) -> Column:
    """ARR-2: distinct, trimmed, lower case, rules applied, the first `most`; `blocked` are parts of addresses, `broker_hosts`
    hosts whose mail and whose subdomains' mail is left out. Distinctness is that before lower-casing."""
    given = F.transform(F.array_distinct(F.filter(_col(emails), lambda e: e != "")), lambda e: F.lower(F.trim(e)))

    def good(e: Column) -> Column:
        local, host = F.substring_index(e, "@", 1), F.regexp_replace(F.substring_index(e, "@", -1), r"^www\.", "")
        bad = e.rlike(BAD_EMAIL) | local.rlike(PLACEHOLDER) | local.rlike(NO_REPLY) | local.rlike(BAD_LOCAL) | host.rlike(BAD_MAIL_HOST)
        for b in blocked:
            bad = bad | e.contains(b)
        if broker_hosts:
            bad = bad | host_in(host, list(broker_hosts))
        return ~bad & e.rlike(GOOD_EMAIL)

    return F.slice(F.filter(given, good), 1, most)


def clean_phones(phones: Column | str, most: int = 8) -> Column:
    """ARR-3: international numbers of 10 to 16 digits, the first `most`."""
    given = F.transform(F.array_distinct(F.filter(_col(phones), lambda p: p != "")), lambda p: normalize_space(p))

    def good(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\D", "")
        zeros = p.startswith("00")
        ok = F.length(digits).between(10, 16) & (p.startswith("+") | zeros) & ~(zeros & p.rlike("[().]"))
        return ok & ~(zeros & ~digits.rlike(r"^00[1-9]\d{9,14}$")) & ~digits.rlike("^000") & ~digits.rlike(r"^20\d{6,}")

    return F.slice(F.filter(given, good), 1, most)


def clean_links(links: Column | str, *, blocked_hosts: list[str] = (), broker_hosts: list[str] = (), shorteners: list[str] = (), allow_broker: bool = False, allow_channels: bool = True) -> Column:
    """ARR-1: distinct addresses in normal form without blocked, referring and shortened ones; video hosts keep channels."""
    urls = F.filter(F.transform(F.array_distinct(F.filter(_col(links), lambda u: u != "")), safe_url), lambda u: u.isNotNull())

    def good(u: Column) -> Column:
        d = domain_of(u)
        path = F.concat(F.lit("/"), F.array_join(path_parts(u), "/"))
        ok = ~is_blocked(u, blocked_hosts) & (d != "youtu.be")
        if not allow_broker:
            ok = ok & ~is_referral(u, broker_hosts)
        if shorteners:
            ok = ok & ~host_in(d, list(shorteners))
        video = (d == "youtube.com") | d.endswith(".youtube.com")
        ok = ok & (~video | (path.rlike("(?i)^/(?:@|channel/|c/|user/)") & F.lit(allow_channels)))
        clip = (d == "tiktok.com") | d.endswith(".tiktok.com")
        return ok & (~clip | path.rlike("(?i)^/@[^/]+/?$"))

    return F.filter(urls, good)


# First path segments that are no profile, for hosts whose profiles are one segment.
ONE_SEGMENT = {
    "calendly.com": ["about", "pricing", "integrations"], "t.me": ["share", "iv", "proxy"], "telegram.me": ["share", "iv", "proxy"], "discord.gg": [],
    "instagram.com": ["p", "reel", "reels", "stories", "explore", "accounts", "about", "privacy", "terms"],
    "x.com": ["i", "share", "intent", "search", "home", "tos", "privacy", "settings"], "twitter.com": ["i", "share", "intent", "search", "home", "tos", "privacy", "settings"],
    "threads.net": ["privacy", "terms", "login"], **{h: ["s", "privacy", "marketplace", "features", "templates", "pricing", "link-in-bio", "solutions", "about", "blog", "help"] for h in ("linktr.ee", "beacons.ai", "bio.link", "msha.ke", "solo.to")},
}
# Of these hosts no subdomains count.
OWN_HOST = ["calendly.com", "t.me", "telegram.me", "discord.gg", "x.com", "twitter.com", "linktr.ee", "beacons.ai", "bio.link", "msha.ke", "solo.to"]
# First path segments that are no page, and those that have one below.
FACEBOOK_NOT, FACEBOOK_BELOW = ["share", "privacy", "terms", "marketplace", "watch", "reel"], ["groups", "pages"]
# First path segments of profiles, for hosts whose profiles are two segments.
TWO_SEGMENTS = {
    "linkedin.com": ["in", "company", "posts"], "reddit.com": ["user", "u"], "tradingview.com": ["u"], "myfxbook.com": ["members", "portfolio", "community"],
    "fxblue.com": ["users"], "zulutrade.com": ["trader"], "darwinex.com": ["darwin"], "signalstart.com": ["analysis"],
}


def is_direct_contact(url: Column | str) -> Column:
    """URL-8: an address at which someone can be written to, by the hosts' path rules."""

    def judged(x: Column) -> Column:
        u, d, p = x["u"], x["d"], x["p"]
        first, second = F.lower(F.get(p, F.lit(0))), F.lower(F.get(p, F.lit(1)))
        below = lambda host: (d == host) | d.endswith("." + host)
        third = F.get(p, F.lit(2))
        out = F.when(d.isin("wa.me", "api.whatsapp.com", "web.whatsapp.com"), u.rlike(r"(?i)(?:wa\.me/|[?&]phone=)\+?\d{8,}"))
        for host, not_first in ONE_SEGMENT.items():
            out = out.when((d == host) if host in OWN_HOST else below(host), (F.size(p) == 1) & ~first.isin([*not_first, *BLOCKED_HANDLES]) & first.rlike(r"^[a-z0-9_.-]{2,80}$"))
        out = out.when(below("tiktok.com"), (F.size(p) == 1) & first.startswith("@") & ~F.substring(first, 2, 200).isin(BLOCKED_HANDLES))
        out = out.when(below("facebook.com") & first.isin(FACEBOOK_BELOW) & second.isNotNull(), ~second.isin(BLOCKED_HANDLES))
        out = out.when(below("facebook.com"), (F.size(p) == 1) & ~first.isin([*FACEBOOK_NOT, *BLOCKED_HANDLES]))
        out = out.when(below("mql5.com"), (first == "en") & second.isin("signals", "users") & third.isNotNull())
        out = out.when(below("linkedin.com") & (first == "feed") & (second == "update"), True)
        for host, sections in TWO_SEGMENTS.items():
            named = F.lit(True) if host != "linkedin.com" else ~second.isin(BLOCKED_HANDLES)
            out = out.when(below(host), first.isin(sections) & second.isNotNull() & named)
        return F.coalesce(out.otherwise(F.lit(False)) & u.isNotNull() & ~is_blocked(u) & ~is_referral(u), F.lit(False))

    return let(safe_url(url), lambda u: let(F.struct(u.alias("u"), domain_of(u).alias("d"), path_parts(u).alias("p")), judged))


def clean_forms(forms: Column | str, most: int = 8) -> Column:
    """ARR-4: array<struct<page_url, action, fields, label>>: forms that reach a person, distinct, the first `most`."""

    def good(f: Column) -> Column:
        page, action = safe_url(f["page_url"]), safe_url(F.coalesce(F.when(f["action"] != "", f["action"]), f["page_url"]))
        target = F.coalesce(page, action)
        words = F.concat_ws(" ", page, action, F.array_join(f["fields"], " "), f["label"])
        fields = F.transform(f["fields"], lambda x: F.lower(x))
        talks = F.exists(fields, lambda x: x.rlike(FORM_MESSAGE)) & F.exists(fields, lambda x: x.rlike(FORM_SENDER))
        return F.coalesce(target.isNotNull() & ~is_blocked(target) & ~is_referral(target) & ~is_referral(action) & ~words.rlike(FORM_JUNK) & (F.lower(words).rlike(FORM_INTENT) | talks), F.lit(False))

    return F.slice(F.array_distinct(F.filter(_col(forms), good)), 1, most)


def best_contact(emails: Column, phones: Column, links: Column, forms: Column) -> Column:
    """ARR-8: struct(contact, kind): e-mail, then WhatsApp, phone, booking, social, form, website."""
    pick = lambda pattern: F.get(F.filter(links, lambda u: u.rlike(pattern)), F.lit(0))
    social = pick(r"(?i)linkedin\.com|instagram\.com|//(?:x|twitter)\.com|//t\.me|tiktok\.com")
    kinds = [("email", F.get(emails, F.lit(0))), ("whatsapp", pick(r"(?i)wa\.me|whatsapp")), ("phone", F.get(phones, F.lit(0))), ("booking", pick("(?i)calendly")), ("social", social), ("form", F.get(forms, F.lit(0))), ("website", F.get(links, F.lit(0)))]
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("contact"), F.lit(k).alias("kind"))) for k, c in kinds))


def contactability(kind: Column) -> Column:
    """ARR-9, SUP-19: confidence by the kind of contact."""
    # Confidence of each kind.
    table = {"whatsapp": 96, "email": 94, "phone": 90, "booking": 86, "form": 82, "social": 74, "website": 45}
    out = F.when(kind.isNull(), 15)
    for k, v in table.items():
        out = out.when(kind == k, v)
    return out.otherwise(15)


def contact_rank(emails: Column, forms: Column, makers: Column, links: Column) -> Column:
    """SRT-2: 4 for e-mails, 3 for forms, 2 for people, 1 for links."""
    return 4 * emails.cast("int") + 3 * forms.cast("int") + 2 * makers.cast("int") + links.cast("int")


def email_quality(email: Column | str, mx: Column | str) -> Column:
    """ARR-13: 0 for malformed; 40, 30 more with a mail server, 20 more for a person's local part."""
    e = F.lower(F.trim(_col(email)))
    person = ~F.substring_index(e, "@", 1).rlike(r"^(?:info|contact|hello|support|sales|admin|office)$")
    score = F.lit(40) + F.when(_col(mx), 30).otherwise(0) + F.when(person, 20).otherwise(0)
    return F.when(e.rlike(f"^{EMAIL}$"), score).otherwise(0)


# Lengths of phone numbers that messaging links take.
CHAT_DIGITS = r"^\d{8,16}$"


def chat_link(digits: Column | str) -> Column:
    """URL-7: the messaging link of a number of 8 to 16 digits, null for others."""
    d = F.regexp_replace(F.coalesce(_col(digits), F.lit("")), r"\D", "")
    return F.when(d.rlike(CHAT_DIGITS), F.concat(F.lit("https://wa.me/"), d))


def normal_chat_link(url: Column | str) -> Column:
    """URL-7: a messaging address with a number, in path or query, as the short link; others as they are."""
    u = safe_url(url)
    number = F.regexp_extract(F.coalesce(u, F.lit("")), r"(?i)(?:wa\.me/|[?&]phone=)(?:%2B|\+)?(\d+)", 1)
    return F.coalesce(F.when(domain_of(u).rlike(r"^(?:wa\.me|(?:[a-z]+\.)?whatsapp\.com)$"), chat_link(number)), u)


def url_kinds(url: Column | str, social_hosts: list[str]) -> Column:
    """SUP-21: struct(social, contact, direct): on a social host, of a contact page, and a direct way to someone."""
    u = safe_url(url)
    social = host_in(domain_of(u), list(social_hosts)) if social_hosts else F.lit(False)
    contact = path_and_query(u).rlike(r"contact|contato|contacto|about|partner|affiliate")
    return F.struct(F.coalesce(social, F.lit(False)).alias("social"), F.coalesce(contact, F.lit(False)).alias("contact"), is_direct_contact(url).alias("direct"))


def split_links(links: Column | str, social_hosts: list[str], most: int = 20) -> Column:
    """ARR-10: struct(social, contact, website) of clean links, the first `most` of each; a link may be in several."""
    clean = clean_links(links)
    pick = lambda good: F.slice(F.filter(clean, good), 1, most)
    social = lambda u: url_kinds(u, social_hosts)["social"]
    return F.struct(pick(social).alias("social"), pick(lambda u: url_kinds(u, social_hosts)["contact"] | is_direct_contact(u)).alias("contact"), pick(lambda u: ~social(u)).alias("website"))


def display(name: Column, title: Column, domain: Column, contact: Column, url: Column, width: int = 78) -> Column:
    """SUP-29: struct(title, href, short): what a list shows of a record, with fallbacks."""
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    c = full(contact)
    href = F.when(c.rlike("^[^@/ ]+@[^@/ ]+$"), F.concat(F.lit("mailto:"), c)).when(c.rlike(r"^\+?[0-9 ().-]{8,}$"), F.concat(F.lit("tel:"), F.regexp_replace(c, "[^0-9+]", ""))).otherwise(c)
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^https?://(?:www\.)?|/$", "")
    short = F.when(F.length(bare) > width, F.concat(F.substring(bare, 1, width - 3), F.lit("..."))).otherwise(bare)
    return F.struct(F.coalesce(full(name), full(title), full(domain), F.lit("Untitled")).alias("title"), href.alias("href"), short.alias("short"))
