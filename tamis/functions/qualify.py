"""Record-level policies: entity keys, contact completeness, qualification, categories, due work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.contacts import clean_emails
from tamis.functions.scoring import cap_tier, clamp, icp_tier
from tamis.functions.text import _col, half_up
from tamis.functions.urls import domain_of, host_in, path_parts, profile_key

# Hosts that many entities share, so that the host alone names none.
SHARED_HOSTS = ["linkedin.com", "instagram.com", "x.com", "twitter.com", "tiktok.com", "youtube.com", "t.me", "telegram.me", "linktr.ee", "beacons.ai"]


def _name_key(name: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), " ", "-")


def entity_key(emails: Column, websites: Column, url: Column, name: Column) -> Column:
    """DED-5: the e-mail's domain, else the website's, else a profile's handle, else the address's host, else the name."""
    mail = F.get(clean_emails(emails), F.lit(0))
    site = F.get(F.filter(F.transform(websites, lambda w: domain_of(w)), lambda d: d != ""), F.lit(0))
    host, first = domain_of(url), F.lower(F.get(path_parts(url), F.lit(0)))
    handle = F.when(host.contains("linkedin.com") & (F.size(path_parts(url)) >= 2), F.lower(F.array_join(F.slice(path_parts(url), 1, 2), "/"))).otherwise(first)
    return (
        F.when(mail.isNotNull(), F.concat(F.lit("domain:"), F.substring_index(mail, "@", -1)))
        .when(site.isNotNull(), F.concat(F.lit("domain:"), site))
        .when((host != "") & handle.isNotNull(), F.concat(F.lit("profile:"), host, F.lit("/"), handle))
        .when(host != "", F.concat(F.lit("domain:"), host))
        .otherwise(F.concat(F.lit("name:"), _name_key(name)))
    )


def canonical_key(emails: Column, url: Column, name: Column) -> Column:
    """DED-3: the first clean e-mail, else the profile or address, else the name."""
    mail = F.get(clean_emails(emails), F.lit(0))
    return F.when(mail.isNotNull(), F.concat(F.lit("email:"), mail)).otherwise(F.coalesce(profile_key(url), F.concat(F.lit("name:"), F.lower(F.coalesce(name, F.lit(""))))))


def company_key(url: Column, name: Column) -> Column:
    """DED-7: the host where it is the company's own, else the profile, else the name."""
    host = domain_of(url)
    own = (host != "") & ~host_in(host, SHARED_HOSTS)
    return F.when(own, F.concat(F.lit("domain:"), host)).when(host != "", profile_key(url)).otherwise(F.concat(F.lit("name:"), _name_key(name)))


def linkage_keys(id_: Column, emails: Column, links: Column, name: Column, country: Column) -> Column:
    """DED-6: all keys under which a record may meet another: id, e-mails, profiles and addresses, a long enough name."""
    weak = _name_key(name)
    named = F.when(F.length(weak) >= 8, F.array(F.concat(F.lit("name:"), weak, F.lit(":"), F.lower(F.coalesce(country, F.lit("")))))).otherwise(F.array().cast("array<string>"))
    mails = F.transform(clean_emails(emails), lambda e: F.concat(F.lit("email:"), e))
    return F.array_distinct(F.array_compact(F.concat(F.array(F.concat(F.lit("id:"), id_.cast("string"))), mails, F.transform(links, lambda u: profile_key(u)), named)))


def weighted(parts: list[tuple[Column, int]]) -> Column:
    """CLS-15: the sum of the weights of what holds."""
    total = F.lit(0)
    for holds, weight in parts:
        total = total + F.when(holds, weight).otherwise(0)
    return total


# Weights of contact completeness and of direct contacts.
COMPLETENESS = {"emails": 30, "phones": 20, "forms": 20, "websites": 10, "makers": 20, "maker_links": 15, "links": 10, "best": 25}
DIRECT = {"emails": 24, "forms": 14, "direct": 16, "phones": 14, "best": 18, "makers": 14, "maker_links": 10}


def completeness(**has: Column) -> Column:
    return weighted([(has[k], w) for k, w in COMPLETENESS.items() if k in has])


def direct_contact_score(**has: Column) -> Column:
    return weighted([(has[k], w) for k, w in DIRECT.items() if k in has])


def outreach_score(lead_type: Column, bucket: Column, priority: Column, score: Column, contact: Column, bonuses: list[tuple[Column, int]] = (), *, has_website: Column | None = None, noise: Column | None = None) -> Column:
    """CLS-10: the second commercial formula: type, bucket and contacts, a quarter of the score, in 0..100. A source alone costs
    30 unless it has a website, generic platform noise 40."""
    has = contact > 0
    total = F.when(lead_type == "partner", 25).when(lead_type == "institution", 22).when(lead_type == "recruitment", 14).otherwise(0)
    total = total + F.when(bucket.isin("linkedin", "instagram", "x", "telegram"), 20).when(bucket.isin("myfxbook", "mql5", "specialist"), F.when(has, 12).otherwise(2)).when((bucket == "tradingview") & has, 6).otherwise(0)
    total = total + weighted(list(bonuses)) + F.least(F.lit(25.0), F.coalesce(score, F.lit(0)) / 4)
    total = total - F.when((bucket == "mql5") & ~has, 18).otherwise(0) - F.when(bucket == "tradingview", F.when(has, 8).otherwise(25)).otherwise(0)
    site, generic = (F.coalesce(x, F.lit(False)) if x is not None else F.lit(False) for x in (has_website, noise))
    total = total - F.when(bucket.isin("mql5", "myfxbook", "tradingview", "specialist", "forum") & ~has & ~site, 30).otherwise(0) - F.when(generic, 40).otherwise(0)
    total = total + F.when(priority == "A", F.when(has, 10).otherwise(-10)).when(priority == "D", -20).otherwise(0)
    return clamp(half_up(total)).cast("int")


def best_channel(has: dict[str, Column]) -> Column:
    """CLS-13: the first channel there is. Keys: email, whatsapp, calendly, linkedin, telegram, instagram, form, website."""
    # The channels' names in order.
    names = [("email", "Email"), ("whatsapp", "WhatsApp"), ("calendly", "Calendly"), ("linkedin", "LinkedIn"), ("telegram", "Telegram"), ("instagram", "Instagram"), ("form", "Contact form"), ("website", "Website research")]
    return F.coalesce(*(F.when(has[k], F.lit(v)) for k, v in names if k in has), F.lit("Source URL"))


def qualify(score: Column, *, emails: Column, phones: Column, forms: Column, links: Column, likelihood: Column, hot_segment: Column, side_segment: Column, intent: Column, n_flags: Column, bucket: Column, strength: Column, channel: Column | None = None) -> Column:
    """PRJ-5: struct(total, tier, meeting_priority): bonuses for contacts, people, segment and intent, six off for each red
    flag; tiers are capped where there is no strong contact."""
    contact = F.when(emails, 22).when(forms, 18).when(links, 15).when(phones, 12).otherwise(0)
    people = F.when(likelihood == "High", 14).when(likelihood == "Medium", 7).otherwise(0)
    segment = F.when(hot_segment, 12).when(side_segment, 8).otherwise(0)
    total = F.coalesce(score, F.lit(0)) + contact + people + segment + F.when(intent, 12).otherwise(0) - 6 * n_flags
    no_channel = channel == "Source URL" if channel is not None else F.lit(False)
    weak = strength.isin("none", "source-only") | ((bucket.isin("mql5", "forum") | no_channel) & (strength != "strong"))
    tier = icp_tier(total)
    tier = F.when(weak, cap_tier(tier, F.lit("B Nurture"))).otherwise(tier)
    meeting = F.when(tier == "A1 Hot", "High").when(tier == "A2 Strong", "Medium-High").when(tier == "B Nurture", "Medium").otherwise("Low")
    return F.struct(total.alias("total"), tier.alias("tier"), meeting.alias("meeting_priority"))


# Source categories and their marks; web is none of the others.
CATEGORIES = {
    "specialist": "mql5|myfxbook|fxblue|zulutrade|darwinex|signalstart|collective2|forexfactory|babypips|specialist",
    "social": r"linkedin|instagram|x/twitter|twitter|telegram|t\.me|discord|tiktok|facebook|threads|reddit",
    "linkedin": "linkedin", "instagram": "instagram", "x-twitter": r"x/twitter|twitter|x\.com", "telegram": r"telegram|t\.me", "discord": "discord",
    "myfxbook": "myfxbook", "mql5": "mql5", "fxblue": "fxblue", "forums": "forexfactory|babypips|earnforex|reddit|forum",
}


def in_category(text: Column, category: str) -> Column:
    """FLT-3, FLT-4: whether a record's source text is of the category; non-mql5 and web are negations."""
    t = F.lower(text)
    if category == "non-mql5":
        return ~t.rlike(CATEGORIES["mql5"])
    if category == "web":
        return ~t.rlike("|".join(CATEGORIES.values()))
    return t.rlike(CATEGORIES[category]) if category in CATEGORIES else F.lit(False)


def due_code(now: Column, last: Column, complete: Column, hot: Column, *, contactless_hours: float = 1, hot_hours: float = 1, stale_hours: float = 6, rotation_hours: float = 2) -> Column:
    """SUP-7, STM-4: never, contactless_due, scheduled_due, rotation_due, or null."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(last)) / 3.6e9)
    ttl = F.when(complete < 35, contactless_hours).when(hot, hot_hours).otherwise(stale_hours)
    return F.when(last.isNull(), "never").when(age >= ttl, F.when(complete < 35, "contactless_due").otherwise("scheduled_due")).when(age >= rotation_hours, "rotation_due")


def due_priority(code: Column) -> Column:
    """SUP-7: contactless, never, scheduled, rotation."""
    return F.when(code == "contactless_due", 0).when(code == "never", 1).when(code == "scheduled_due", 2).when(code == "rotation_due", 3).otherwise(9)


def queue_rank(bucket: Column) -> Column:
    return F.when(bucket.isin("linkedin", "instagram", "x", "telegram", "discord", "tiktok"), 0).when(bucket.isin("forum", "recruitment"), 1).when(bucket.isin("myfxbook", "tradingview", "specialist"), 2).when(bucket == "mql5", 3).otherwise(5)


def touched_at(*times: Column | str) -> Column:
    """FLT-25, SUP-25: the latest of the times that are there."""
    return F.greatest(*map(_col, times)) if len(times) > 1 else _col(times[0])


def longer(a: Column, b: Column) -> Column:
    """SUP-18: the longer text; the first on ties; the other where one is missing."""
    return F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)


def client_category(text: Column, category: str) -> Column:
    """SUP-31: the category filter of the screen, which differs: web is what is neither specialist nor social, and an unknown
    category is a substring."""
    t = F.lower(F.coalesce(text, F.lit("")))
    if category == "web":
        return ~t.rlike(f"{CATEGORIES['specialist']}|{CATEGORIES['social']}")
    return t.rlike(CATEGORIES[category]) if category in CATEGORIES else t.contains(category.lower())
