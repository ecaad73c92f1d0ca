"""URL expressions: normal form, host, suffixes, platform, ids, handles. Built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import _col, let, normalize_space

_PARTS = r"(?i)^\s*(https?)://(?:[^/?#@\s]*@)?([^/?#:\s]+)(?::(\d+))?([^?#]*)(\?[^#]*)?(#.*)?$"

# Hosts and their platform labels, in order of precedence.
PLATFORMS = [
    ("linkedin.com", "LinkedIn"), ("instagram.com", "Instagram"), ("x.com", "X/Twitter"), ("twitter.com", "X/Twitter"),
    ("youtube.com", "YouTube"), ("youtu.be", "YouTube"), ("facebook.com", "Facebook"), ("tiktok.com", "TikTok"),
    ("threads.net", "Threads"), ("reddit.com", "Reddit"), ("t.me", "Telegram"), ("telegram.me", "Telegram"),
    ("discord.gg", "Discord"), ("discord.com", "Discord"), ("tradingview.com", "TradingView"),
    ("myfxbook.com", "Myfxbook"), ("mql5.com", "MQL5"), ("fxblue.com", "FXBlue"), ("zulutrade.com", "ZuluTrade"),
    ("darwinex.com", "Darwinex"), ("signalstart.com", "SignalStart"), ("collective2.com", "Collective2"),
    ("forexfactory.com", "ForexFactory"), ("babypips.com", "BabyPips"), ("adviserinfo.sec.gov", "Regulatory Registry"), ("sec.gov", "Regulatory Registry"),
    ("register.fca.org.uk", "Regulatory Registry"), ("opencorporates.com", "Company Registry"),
    ("linktr.ee", "Link Hub"), ("beacons.ai", "Link Hub"), ("bio.link", "Link Hub"), ("msha.ke", "Link Hub"), ("solo.to", "Link Hub"),
]
# Hosts that are a platform only with a subdomain.
BELOW_HOSTS = [
    ("telegram.org", "Telegram"), ("fca.org.uk", "Regulatory Registry"), ("cvm.gov.br", "Regulatory Registry"), ("cnmv.es", "Regulatory Registry"), ("cmfchile.cl", "Regulatory Registry"), ("superfinanciera.gov.co", "Regulatory Registry"),
    ("asic.gov.au", "Regulatory Registry"), ("mas.gov.sg", "Regulatory Registry"), ("sfc.hk", "Regulatory Registry"), ("dfsa.ae", "Regulatory Registry"), ("adgm.com", "Regulatory Registry"), ("companieshouse.gov.uk", "Company Registry"),
]
# A part of a host that makes it a registry.
REGISTRY_PART = "company-information.service.gov.uk"
# Hosts that are a platform only without a subdomain.
EXACT_HOSTS = ["adviserinfo.sec.gov", "sec.gov", "register.fca.org.uk", "x.com", "twitter.com", "youtu.be", "t.me", "telegram.me", "discord.gg", "discord.com", "linktr.ee", "beacons.ai", "bio.link", "msha.ke", "solo.to"]
# Addresses that are never kept.
BAD_URL = r"(?i)/s/desktop/|/jsbin/|favicon|initplayback|error_204|csi_204|/installer/download/|(?:\\n|%5cn|/n[a-z0-9])|cart\.php|\.(?:png|jpe?g|gif|webp|svg|ico|css|js|mjs|map|woff2?|ttf|eot|mp4|webm|m3u8|pdf)/?(?:[?#].*)?$"
# Marks of referrals in path and query.
REFERRAL = r"(?i)(?:^/r/|/r/|affiliate-program|register|registration|login|signup|sign-up|campaign|promo_code|utm_source=affiliate|utm_medium=affiliate|ref=|referral|affid|affiliate_id|partner_id|wpam_id|ppu=|clickid=|lid=)"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def safe_url(url: Column | str) -> Column:
    """URL-1: http(s) addresses in normal form: scheme and host in lower case, no default port, a path, no fragment, blanks
    escaped. Others are null."""
    u = _col(url)
    scheme, host, port, path, query = F.lower(_part(u, 1)), F.lower(_part(u, 2)), _part(u, 3), F.rtrim(_part(u, 4)), F.rtrim(_part(u, 5))
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)
    return F.when(host != "", F.regexp_replace(out, " ", "%20"))


def domain_of(url: Column | str) -> Column:
    """URL-2: the host in lower case without one leading www.; empty for what is no address."""
    return F.regexp_replace(F.lower(_part(F.coalesce(_col(url), F.lit("")), 2)), r"^www\.", "")


def path_parts(url: Column | str) -> Column:
    return F.filter(F.split(_part(F.coalesce(_col(url), F.lit("")), 4), "/"), lambda p: p != "")


def path_and_query(url: Column | str) -> Column:
    u = F.coalesce(_col(url), F.lit(""))
    return F.lower(F.concat(F.when(_part(u, 4) == "", "/").otherwise(_part(u, 4)), F.lit(" "), _part(u, 5)))


def domain_suffixes(domain: Column | str) -> Column:
    """JOIN-4: a host and all its parents, so that "is or ends in" is an equality."""
    parts = F.split(_col(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_in(domain: Column | str, hosts: list[str]) -> Column:
    """Whether the host is one of `hosts` or below one. For longer lists join on `domain_suffixes`."""
    return F.arrays_overlap(domain_suffixes(domain), F.array(*map(F.lit, hosts)))


def platform_of(url: Column | str) -> Column:
    """URL-4: the platform's label; Web for other hosts, empty for what is no address."""
    d = domain_of(url)
    out = None
    for host, label in PLATFORMS:
        hit = (d == host) if host in EXACT_HOSTS else (d == host) | d.endswith("." + host)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    for host, label in BELOW_HOSTS:
        out = out.when(d.endswith("." + host), label)
    out = out.when(d.contains(REGISTRY_PART), "Company Registry")
    return F.when(d == "", "").otherwise(out.otherwise("Web"))


def record_id(url: Column | str, title: Column | str) -> Column:
    """URL-5: 16 hex digits of the SHA-1 of host, address and lower-case title."""
    u, t = F.coalesce(_col(url), F.lit("")), F.coalesce(_col(title), F.lit(""))
    return F.substring(F.sha1(F.concat_ws("|", domain_of(u), u, F.lower(t))), 1, 16)


def title_from_url(url: Column | str) -> Column:
    """STR-4: the last two path segments as words, else the host."""
    parts = path_parts(url)
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    words = F.when(F.size(parts) > 0, F.regexp_replace(F.array_join(tail, " "), "[-_]", " ")).otherwise(F.lit(""))
    return normalize_space(F.when(words == "", domain_of(url)).otherwise(words))


def is_blocked(url: Column | str, blocked_hosts: list[str] = ()) -> Column:
    """URL-6: no address, a blocked host, or one of the bad patterns."""
    u = safe_url(url)
    blocked = host_in(domain_of(u), list(blocked_hosts)) if blocked_hosts else F.lit(False)
    return F.coalesce(u.isNull() | blocked | u.rlike(BAD_URL), F.lit(True))


def is_referral(url: Column | str, broker_hosts: list[str] = ()) -> Column:
    """URL-6: a broker's host, or a mark of a referral in path and query."""
    u = safe_url(url)
    broker = host_in(domain_of(u), list(broker_hosts)) if broker_hosts else F.lit(False)
    return F.coalesce(broker | path_and_query(u).rlike(REFERRAL), F.lit(False))


def unwrap_redirect(url: Column | str) -> Column:
    """URL-3: the target that a search engine's redirect carries in /RU=, uddg=, url= or u=, else the address itself."""

    def target(u: Column) -> Column:
        found = [F.regexp_extract(u, p, 1) for p in (r"/RU=([^/]+)", r"[?&]uddg=([^&#]+)", r"[?&]url=(https?[^&#]+)", r"[?&]u=(https?[^&#]+)")]
        plain = F.coalesce(*(F.when(f != "", F.try_url_decode(F.replace(f, F.lit("+"), F.lit("%2B")))) for f in found))
        packed = F.translate(F.regexp_extract(u, r"[?&]u=a1([A-Za-z0-9_-]+)", 1), "-_", "+/")
        padded = F.rpad(packed, F.length(packed) + F.pmod(-F.length(packed), F.lit(4)), F.lit("="))
        decoded = F.when(packed != "", F.try_to_binary(padded, F.lit("base64")).cast("string"))
        return F.coalesce(plain, F.when(decoded.rlike("(?i)^https?:"), decoded), u)

    return let(target(_col(url)), safe_url)


def profile_key(url: Column | str) -> Column:
    """URL-10: platform and handle of a profile address, or host and path."""
    d, p = domain_of(url), path_parts(url)
    first, second = F.lower(F.get(p, F.lit(0))), F.lower(F.get(p, F.lit(1)))
    path = F.array_join(p, "/")
    return (
        F.when(((d == "linkedin.com") | d.endswith(".linkedin.com")) & second.isNotNull(), F.concat(F.lit("linkedin:"), first, F.lit("/"), second))
        .when(((d == "instagram.com") | d.endswith(".instagram.com")) & first.isNotNull(), F.concat(F.lit("instagram:"), first))
        .when(d.isin("x.com", "twitter.com") & first.isNotNull(), F.concat(F.lit("x:"), first))
        .when(d.isin("t.me", "telegram.me") & first.isNotNull(), F.concat(F.lit("telegram:"), first))
        .when(((d == "youtube.com") | d.endswith(".youtube.com")) & first.isNotNull(), F.concat(F.lit("youtube:"), F.lower(F.array_join(F.slice(p, 1, 2), "/"))))
        .when(d != "", F.concat(F.lit("url:"), d, F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.lower(path)))))
    )


def whatsapp_url(digits: Column | str) -> Column:
    """URL-7: 8 to 16 digits as an address, others null."""
    d = F.regexp_replace(_col(digits), r"\D", "")
    return F.when(F.length(d).between(8, 16), F.concat(F.lit("https://wa.me/"), d))


# Where sites tell how to reach them.
CONTACT_PATHS = ["/contact", "/contact-us", "/contacts", "/contato", "/contacto", "/about", "/about-us", "/partners", "/partnership", "/affiliate", "/affiliates", "/team"]


def contact_candidates(url: Column | str) -> Column:
    """URL-11: the site's twelve likely contact addresses."""
    root = F.regexp_extract(safe_url(url), r"^(https?://[^/?#]+)", 1)
    return F.transform(F.array(*map(F.lit, CONTACT_PATHS)), lambda p: F.concat(root, p))


def site_constraint(query: Column | str) -> Column:
    """FLT-19: struct(host, path) of a query's site: term, empty without one."""
    q = F.lower(_col(query))
    found = F.regexp_extract(q, r"site:(?:https?://)?(?:www\.)?([^\s/]+)(/[^\s]*)?", 1)
    return F.struct(found.alias("host"), F.regexp_replace(F.regexp_extract(q, r"site:(?:https?://)?(?:www\.)?([^\s/]+)(/[^\s]*)?", 2), "/$", "").alias("path"))


def matches_site(url: Column | str, constraint: Column) -> Column:
    """FLT-19: without a constraint everything matches; else host or a host below it, and the path's beginning."""
    d = domain_of(url)
    path = F.lower(_part(F.coalesce(_col(url), F.lit("")), 4))
    host_ok = (d == constraint["host"]) | d.endswith(F.concat(F.lit("."), constraint["host"]))
    return (constraint["host"] == "") | (host_ok & path.startswith(constraint["path"]))
