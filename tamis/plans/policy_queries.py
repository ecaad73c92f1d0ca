"""Queries of the lead policies over a relation with the facts of a lead, each with SQL for the same rows.

The rules are the library's; the vocabularies here are a small demonstration set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import views as V
from tamis.functions.policies import FLAGS, NUMBERS, TEXTS, Policy, blocked_query
from tamis.operators import core as O
from tamis.plans.demo import table
from tamis.sources.sinks import csv_lines

#: A demonstration vocabulary.
DEMO = {
    "review": r"(?i)\b(review|ranking)\b", "review_path": r"/(reviews|best)/", "job": r"(?i)\b(vacancy|apply for this job)\b", "directory": r"(?i)\b(directory|members list)\b", "broker_page": r"(?i)\bopen account\b",
    "prop_company": r"(?i)\bprop company\b", "official_prop": r"^(.*\.)?funded\.example$", "review_domain": r"^(.*\.)?reviews\.example$", "decision_maker": r"(?i)\b(founder|owner|head of)\b", "trading": r"(?i)\b(forex|gold trader|signals)\b",
    "profile": r"(?i)\bpublic profile\b", "company_path": r"/(company|partners)/", "contact": r"(?i)\b(contact us|telegram)\b", "partner_words": r"(?i)\b(affiliate|partner)\b", "strict_icp": r"(?i)\b(forex|gold trader)\b",
    "strong_trading": r"(?i)\bforex\b", "partner_entity": r"(?i)\b(academy|community)\b", "specialist_url": r"(?i)\b(signalhub|copyhub)\b", "social_platform": r"(?i)^(linkedin|instagram)$", "allocator": r"(?i)\b(fund|portfolio) manager\b",
    "asset_context": r"(?i)\bfx\b", "recruiter": r"(?i)\bcountry manager\b", "broker_identity": r"(?i)\b(acme|zenith) markets\b", "broker_official": r"(?i)\bofficial\b", "official_domain": r"^(.*\.)?acme\.example$", "searchable": r"(?i)\bcopy trading\b",
    "forum_page": r"(?i)forum|/thread/", "event_page": r"(?i)\b(expo|summit)\b", "directory_page": r"(?i)\b(leaderboard|directory)\b", "direct_profile": r"(linkedin|instagram)\.example/(in|company)?/?[a-z0-9]+$", "person_words": r"(?i)\b(founder|trader|academy)\b",
    "generic_portal": r"(?i)/(chart|calendar)\b", "video_url": r"(?i)video\.example", "export_noise": r"(?i)\b(login|download)\b", "education": r"(?i)\b(course|academy)\b", "finance_media": r"(?i)\b(economist|bank)\b", "finance_trader": r"(?i)\b(forex|fund manager)\b",
    "broker_name": r"(?i)^(acme|zenith)\b", "market_page": r"/(markets|symbols)/", "synthetic": r"(?i)^extracted candidate", "infra": r"(?i)\bhelp center\b", "infra_domain": r"^(.*\.)?widget\.example$", "cfd_context": r"(?i)\btrad(er|ing)\b",
    "payments": r"(?i)\bmoney transfers\b", "cfd_noise": r"(?i)\bfluid dynamics\b", "video_identity": r"(?i)\bforex\b", "job_domain": r"^(.*\.)?jobs\.example$", "marketing": r"(?i)\bsocial media tips\b", "farm_domain": r"^(.*\.)?wiki\.example$",
    "explainer": r"(?i)\b(what is|guide to)\b", "reach_out": r"(?i)\b(contact us|affiliate)\b", "software": r"(?i)\bpayroll software\b", "review_page": r"(?i)\branking\b", "bank_domain": r"^(.*\.)?bank\.example$", "insurance": r"(?i)\binsurance\b",
    "news": r"(?i)\bbreaking news\b", "finance_role": r"(?i)\beconomist\b", "consumer": r"(?i)\bfootball club\b", "content_domain": r"^(.*\.)?gov\.example$", "weak_name": r"(?i)^(forex|signals)$", "seller_profile": r"/seller$",
    "prop_name": r"(?i)\bfundednow\b", "prop_category": r"(?i)\bprop firm\b", "partner_role": r"(?i)\baffiliate manager\b", "broker_site": r"(?i)\bclient portal\b", "social_noise": r"(?i)\bphotos and videos\b", "target": r"(?i)\b(forex|copy trading|fund manager)\b",
    "generic_page": r"(?i)\bdashboard\b", "reference_site": r"(?i)dictionary|wiki\.example", "malformed_title": r"(?i)^\)? *posts", "broker_noise": r"(?i)\bacme markets\b", "insider": r"(?i)\bcountry manager\b", "actual_signal": r"(?i)\b(forex|gold trader|copy trading)\b",
    "finance_noise": r"(?i)\bbasics of\b", "specialist_words": r"(?i)\b(signals|copy trading)\b", "trusted_bucket": r"^(linkedin|instagram|telegram|forum|specialist)$", "research_signal": r"(?i)\b(expo|which broker)\b", "exchange_domain": r"^(.*\.)?exchange\.example$",
    "false_positive_domain": r"^(.*\.)?kit\.example$", "press": r"(?i)\bpress release\b", "cache_page": r"cache\.aspx", "telegram_page": r"(?i)view @telegram", "social_directory": r"(?i)public\.example", "social_words": r"(?i)\b(community|signals)\b",
    "platform_page": r"(?i)\b(sign in|dashboard)\b", "platform_noise": r"(?i)\bgame console\b", "factory": r"(?i)\bfactory\b", "factory_words": r"(?i)\bcontact\b", "market_words": r"(?i)\bchart page\b", "market_own": r"(?i)\bcontact\b", "latin": r"(?i)\b(brazil|mexico)\b",
    "blocked_query": r"(?i)\bfunded account\b", "query_rank": r"(?i)\b(best|top)\b", "event_words": r"(?i)\b(expo|summit)\b", "exhibitor_words": r"(?i)\bexhibitors?\b", "trail_noise": r"(?i)careers?|sign in", "identity_trading": r"(?i)\b(forex|signals)\b",
    "ui_noise": r"(?i)\bhotel\b", "ui_explainer": r"(?i)\bwhat is\b", "intent": r"(?i)\bwhich broker\b", "bad_terms": r"(?i)\bcurrency rates\b", "hot_segment": r"^(IB / Partner|Affiliate|Community)$", "recruiting_segment": r"^Broker Talent$",
    "own_profile": r"(?i)(instagram|telegram)\.example/[a-z0-9]+", "decision_link": r"linkedin\.example/in/", "company_link": r"linkedin\.example/company/", "whatsapp": r"(?i)wa\.example", "booking": r"(?i)book\.example", "telegram": r"(?i)telegram\.example",
    "instagram": r"(?i)instagram\.example", "article": r"(?i)\b(what is|guide to)\b", "learning_path": r"/(chart|reviews)\b", "explainer_path": r"/thread/", "explainer_contact": r"(?i)\b(contact us|community|telegram)\b", "marketing_domain": r"^(.*\.)?site\.example$",
    "payments_trading": r"(?i)\bforex trader\b", "audit_icp": r"(?i)\b(forex|signals|fund manager)\b", "linkedin": r"(?i)linkedin\.example",
}

_NAMES = "Ana Forex|Posts of the day|Acme markets|Signals|Gold Trader Club|Bruno Lima|Zenith Academy|fundednow team|Copy Trading Lab|The Economist desk|Maria Fund|Chart page"
_TITLES = "Founder|Forex community|Fund manager|Country manager|Review of brokers|Public profile|Dashboard|Affiliate manager|Directory of traders|Owner|Academy|Expo 2024"
_TEXTS = "Forex signals and copy trading for Brazil, contact us on telegram|What is a CFD? Basics of trading|Acme markets official client portal, open account|Head of a fund manager team in fx|Which broker do you use? Community forum|Apply for this job: vacancy in a bank|Breaking news from the economist|Money transfers and currency rates|Extracted candidate for gold trader|Prop firm challenge with affiliate program|Ranking and review of signals|Football club dashboard|Expo exhibitors list, summit of partners|Insurance and payroll software|Photos and videos of a hotel|Gold trader academy course, contact us|Seen on TradingView charts|We take Google Pay here|NBA standings of today|Overleaf LaTeX templates|Forex expo list on scribd.com|Conference with exhibitor list"
_HOSTS = "linkedin.example|instagram.example|telegram.example|acme.example|forum.example|wiki.example|reviews.example|funded.example|video.example|jobs.example|signalhub.example|site.example|bank.example|www.reddit.com|instagram.com|x.com|forexfactory.com"
_PATHS = "in/ana|company/ib|thread/12|markets/eur|chart|reviews/top|partners/br|public|seller|user7|user/z|reel/3|search?q=a|"
_BUCKETS = "linkedin|instagram|telegram|forum|web|mql5|myfxbook|specialist|tradingview|x|reddit|discord|ecosystem"
_SEGMENTS = "IB / Partner|Affiliate|Trading Education|Community|Creator / Influencer|Event / Expo|Broker Site|Fund / Asset Manager|Broker Talent|Unclear|Prop / Funded Trading"


def _pick(values: str, factor: int, n: int) -> str:
    return f"split_part('{values}', '|', CAST((o_orderkey * {factor} + o_custkey) % {n} + 1 AS INT))"


def _flag(factor: int, n: int) -> str:
    return f"(o_orderkey * {factor} + o_custkey) % {n} = 0"


_n = {c: f"CAST((o_orderkey * {f} + o_custkey) % {m} % {k} AS INT)" for c, f, m, k in (
    ("n_emails", 3, 7, 3), ("n_phones", 5, 11, 2), ("n_forms", 7, 13, 2), ("n_links", 11, 5, 3), ("n_direct", 13, 6, 2), ("n_websites", 17, 4, 2), ("n_makers", 19, 17, 2), ("n_maker_links", 23, 9, 2), ("n_countries", 3, 3, 3),
    ("path_parts", 5, 4, 4), ("contact_confidence", 29, 101, 101), ("score", 37, 101, 101), ("commercial_score", 53, 97, 97), ("hours_since_deep", 31, 800, 800), ("hours_running", 7, 5, 5), ("hours_since_trail", 11, 24, 24), ("hours_since_gap", 13, 6, 6))}
#: Leads with all facts, one for each order; the same text in both engines.
_ROWS = f"""SELECT o_orderkey AS id, {_pick(_NAMES, 7, 12)} AS name, {_pick(_TITLES, 5, 12)} AS title, {_pick(_TEXTS, 3, 22)} AS snippet, {_pick(_HOSTS, 11, 17)} AS domain, {_pick(_PATHS, 13, 14)} AS path,
  {_pick(_BUCKETS, 17, 13)} AS bucket, {_pick(_SEGMENTS, 19, 11)} AS segment, {_pick('partner|recruitment|institution|research', 23, 4)} AS lead_type, {_pick('A|B|C|D', 29, 4)} AS priority,
  {_pick('partner|intent|forum|social|specialist|ecosystem|recruitment', 31, 7)} AS source_intent, {_pick('research_candidate|rejected||qualified', 37, 4)} AS qualification_status, {_pick('qualified|rejected|manual_review|trash', 41, 4)} AS quality_status,
  {_pick('company|prop_firm_company|job_posting|decision_maker||social_profile|partner_entity|company|company|social_profile|partner_entity', 43, 11)} AS entity_type, {_pick('|new|contacted|research', 47, 4)} AS stage, {_pick('||||called', 53, 5)} AS notes,
  {_pick('running|done|', 59, 3)} AS deep_status, {_pick('email|website|form||social', 61, 5)} AS best_type, {_pick('Brazil|Unknown||Spain', 67, 4)} AS country, {_pick('best forex ib|expo exhibitors|which broker|funded account', 71, 4)} AS query, {_pick('||12k followers', 73, 3)} AS audience,
  {', '.join(f'{e} AS {c}' for c, e in _n.items())},
  {_flag(3, 7)} AS owned_best, {_flag(5, 9)} AS owned_email, {_flag(7, 2)} AS has_best, {_flag(11, 23)} AS placeholder_email, {_flag(13, 3)} AS profile_best, {_flag(29, 8)} AS owned_links, {_pick('|https://wa.example/1|https://telegram.example/ana|https://telegram.example/b https://wa.example/2', 79, 4)} AS direct_links, {_flag(17, 4)} AS never_enriched, {_flag(19, 29)} AS manual_keep, o_orderdate AS last_seen
  FROM orders"""
_FACTS = f"""SELECT *, 'https://' || domain || '/' || path AS url, split_part(domain, '.', 1) AS platform, name || ' ' || title || ' ' || snippet AS visible, name || ' ' || title || ' https://' || domain || '/' || path AS identity,
  name || ' ' || title || ' ' || snippet || ' https://' || domain || '/' || path AS text, '' AS tier FROM ({_ROWS}) r"""
FACTS_SQL = f"facts AS ({_FACTS})"
POLICY = Policy(DEMO, hours=(24, 72, 336, 300))

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def facts(spark: SparkSession, d: str) -> DataFrame:
    # Functions and operators of this text mean the same in both engines.
    return spark.sql(_FACTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def oracle(columns: list[str], wanted: list[str], where: str = "TRUE", tail: str = "") -> str:
    chain, last = POLICY.query("facts", wanted)
    return f"WITH {FACTS_SQL}{', ' if chain else ''}{chain} SELECT {', '.join(columns)} FROM {last} WHERE {where} {tail}"


def policy_query(name: str, *columns: str) -> None:
    """Registers a query of these derived columns for every lead."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return POLICY.apply(facts(spark, d), list(columns)).select("id", *columns)

    QUERIES[name] = run
    ORACLES[name] = oracle(["id", *columns], list(columns))


policy_query("pol_rejection_reasons", "reject_reasons", "n_rejections", "n_hard_rejections")
policy_query("pol_export_gate", "export_gate", "export_ok")
policy_query("pol_working_gate", "working_gate")
policy_query("pol_research_gate", "research_gate")
policy_query("pol_screen_gates", "api_gate", "snapshot_gate")
policy_query("pol_sales_gate", "contact_score", "sales_gate")
policy_query("pol_prune_reasons", "prune_reasons")
policy_query("pol_noise_reason", "protected", "noise_reason")
policy_query("pol_cleanup_reason", "cleanup_reason")
policy_query("pol_discard_reason", "discard_reason", "keep_lead")
policy_query("pol_lead_type", "segment_now", "lead_type_now")
policy_query("pol_entity", "entity", "entity_signals", "entity_score", "entity_tier", "entity_quality", "commercially_rejected")
policy_query("pol_kind", "kind_reason", "actual_lead")
policy_query("pol_icp_signals", "strong_trading", "partner_entity", "specialist", "strict_icp", "official_broker", "searchable")
policy_query("pol_contact_signals", "validated_contact", "actionable_contact", "real_contact", "decision_contact", "owned_decision_contact", "decision_path", "website_only", "contactless")
policy_query("pol_page_signals", "forum_page", "event_page", "directory_page", "direct_profile", "company_or_person", "generic_portal", "contact_first")
policy_query("pol_blocked", "prop_firm", "target", "blocked")
policy_query("pol_scores", "contact_points", "completeness", "contact_score", "report_contact_score", "source_only", "outreach", "gap_score")
policy_query("pol_channel", "channel", "play", "next_action", "likelihood", "strength")
policy_query("pol_qualify", "icp_tier", "meeting_priority", "hot", "qualification_reasons", "red_flags", "qualified_contactable")
policy_query("pol_due", "enrichable", "due", "refresh_hours")
policy_query("pol_work_targets", "trail_target", "needs_trail", "gap_target", "needs_boost", "search_trail")
policy_query("pol_suspicious", "suspicious", "n_suspicious")


def hit(column: str, name: str) -> str:
    return f"regexp_matches({column}, '{DEMO[name]}')"


def listed(*cases: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for label, cond in cases) + "], lambda r: r IS NOT NULL), '; ')"


#: Rules of the oracle below are written anew, as the lists in policies.py are what is tested; the signals that they read
#: (a strict ICP, an official broker, commercial noise) have oracles of their own.
_farm, _contact = hit("domain", "farm_domain"), hit("text", "explainer_contact")
HAND_REJECTIONS = [
    ("synthetic search snippet without visible ICP evidence", f"{hit('snippet', 'synthetic')} AND NOT {hit('visible', 'strict_icp')}"), ("platform/help/widget/infra result", f"{hit('text', 'infra')} OR {hit('domain', 'infra_domain')}"),
    ("official broker/brokerage page", "official_broker"), ("missing strict forex/CFD/trading ICP signal", "NOT strict_icp"), ("non-trading .cfd domain/page", f"ends_with(domain, '.cfd') AND NOT {hit('visible', 'cfd_context')}"),
    ("payments/money-transfer page, not trading ICP", f"{hit('visible', 'payments')} AND NOT {hit('visible', 'payments_trading')}"), ("non-trading CFD/acronym noise", f"{hit('text', 'cfd_noise')} AND NOT {hit('text', 'cfd_context')}"),
    ("legacy YouTube result without trading identity", f"{hit('url', 'video_url')} AND {hit('snippet', 'synthetic')} AND NOT {hit('identity', 'video_identity')}"), ("job listing/careers page", f"{hit('domain', 'job_domain')} OR {hit('text', 'job')}"),
    ("generic market/chart page", hit("url", "market_page")), ("generic social-media/marketing page", f"NOT strong_trading AND ({hit('domain', 'marketing_domain')} OR {hit('text', 'marketing')})"),
    ("generic article/reference page", _farm), ("generic explainer/reference page", f"NOT {_contact} AND ({hit('url', 'explainer_path')} OR {hit('text', 'explainer')})"), ("non-trading business software page", hit("text", "software")),
    ("generic article/reference page", f"NOT {_farm} AND {hit('text', 'article')} AND ({hit('url', 'learning_path')} OR NOT partner_entity)"), ("generic ranking/review page", f"NOT {hit('text', 'reach_out')} AND ({hit('domain', 'review_domain')} OR {hit('text', 'review_page')})"),
    ("generic bank/asset-management institution page", f"{hit('domain', 'bank_domain')} AND (NOT strong_trading OR NOT partner_entity)"), ("insurance broker, not trading broker", f"{hit('text', 'insurance')} AND NOT strong_trading"),
    ("generic news/government result", f"{hit('text', 'news')} AND NOT strong_trading"), ("generic finance analyst/media result", f"{hit('text', 'finance_role')} AND NOT strong_trading"), ("consumer/sports/forum noise", hit("text", "consumer")),
]
_strict, _video, _weak = hit("visible", "strict_icp"), hit("url", "video_url"), hit("name", "weak_name")
HAND_PRUNE = [(f"hard reject: {label}", cond) for label, cond in HAND_REJECTIONS] + [
    ("commercial noise policy", "blocked"), ("platform/help/widget/infra domain", hit("domain", "infra_domain")), ("known non-lead/content/government domain", f"{hit('domain', 'content_domain')} AND NOT {_strict}"),
    ("synthetic search snippet inflated lead", f"{hit('snippet', 'synthetic')} AND best >= 60"), ("weak/generic identity with high score", f"{_weak} AND best >= 75"), ("placeholder/platform email contamination", "placeholder_email OR owned_email"),
    ("best contact is platform-owned URL", "has_best AND owned_best"), ("high-score lead without real decision contact", "best >= 75 AND NOT route"), ("content/community lead without contact route", "bucket IN ('forum', 'reddit', 'web') AND best >= 70 AND NOT route"),
    ("discord/community lead without contact route", "bucket = 'discord' AND best >= 65 AND NOT route"), ("query-driven social result", f"bucket IN ('linkedin', 'instagram', 'tiktok', 'x', 'facebook') AND {hit('snippet', 'synthetic')}"),
    ("platform strategy profile without owned contact route", f"bucket IN ('fxblue', 'zulutrade', 'specialist') AND NOT route AND {hit('url', 'specialist_url')}"), ("YouTube lead without contact route", f"{_video} AND NOT route"),
    ("weak/contaminated YouTube lead", f"{_video} AND (owned_email OR NOT {_strict})"), ("high score without visible ICP evidence", f"NOT {_strict} AND best >= 85 AND NOT {hit('url', 'seller_profile')}"), ("insufficient lead evidence text", "length(text) < 18"),
]
_icp = hit("visible", "audit_icp")
HAND_SUSPICIOUS = [
    ("placeholder/generic emails", "placeholder_email"), ("platform-owned email still present", "owned_email"), ("bestContact is the source/platform profile", "has_best AND profile_best"), ("bestContact is platform/widget/infra-owned URL", "has_best AND owned_best"),
    ("high-score lead without real decision contact", "best >= 75 AND NOT decided"), ("high-score lead without actual ICP terms in result/profile text", f"best >= 75 AND NOT {_icp}"), ("score likely inflated by synthetic search snippet", f"best >= 75 AND {hit('snippet', 'synthetic')}"),
    ("generic or weak identity/title", f"best >= 75 AND {_weak}"), ("social profile appears query-driven, not profile-driven", f"best >= 75 AND bucket IN ('linkedin', 'instagram', 'tiktok', 'x', 'facebook') AND NOT {hit('identity', 'audit_icp')} AND NOT {hit('left_over', 'audit_icp')}"),
    ("specialist/platform lead has weak contact score", "best >= 75 AND sales_points < 45 AND bucket IN ('mql5', 'myfxbook', 'fxblue', 'zulutrade', 'specialist')"), ("platform-owned links still attached", "owned_links"), ("website-only route, not execution-ready", "n_websites > 0 AND NOT decided"),
]
_SIGNALS, _AFTER = POLICY.query("facts", ["strict_icp", "official_broker", "strong_trading", "partner_entity", "blocked", "enrichable", "outreach"])
_SUM = "(n_emails > 0)::INT * 30 + (n_phones > 0)::INT * {phone} + (n_forms > 0)::INT * {form}"
_ROUTES = f"(regexp_matches(direct_links, '{DEMO['whatsapp']}'))::INT * 40 + (regexp_matches(direct_links, '{DEMO['telegram']}'))::INT * 35 + {_SUM.format(phone=25, form=18)}"
_makers = "(n_makers > 0 OR n_maker_links > 0)::INT"
HAND = f"""WITH {FACTS_SQL}, {_SIGNALS},
n AS (SELECT *, CASE WHEN commercial_score <> 0 THEN commercial_score ELSE score END AS best, n_emails + n_phones + n_forms + n_links > 0 OR (has_best AND best_type <> '' AND best_type <> 'website') AS route,
  has_best AND best_type <> 'website' AND NOT profile_best AND NOT owned_best AS real_best, {_SUM.format(phone=20, form=20)} + (n_websites > 0)::INT * 10 + (n_makers > 0)::INT * 20 + (n_maker_links > 0)::INT * 15 + (n_links > 0)::INT * 10 + has_best::INT * 25 AS complete,
  CASE WHEN contains(visible, query) AND query <> '' THEN left(visible, strpos(visible, query) - 1) || right(visible, length(visible) - strpos(visible, query) - length(query) + 1) ELSE visible END AS left_over,
  lower(text || ' ' || bucket) AS flat, lower(regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1)) AS head FROM {_AFTER}),
c AS (SELECT *, n_emails + n_phones + n_forms + n_direct > 0 OR real_best AS decided, {_ROUTES} + (n_websites > 0)::INT * 5 + {_makers} * 15 + real_best::INT * 20 AS sales_points, {_ROUTES} + (n_websites > 0)::INT * 10 + {_makers} * 20 + has_best::INT * 20 AS report_points FROM n)"""


def by_hand(name: str, **columns: str) -> None:
    """Puts SQL that doesn't come from the policy's rules in place of an oracle that does."""
    ORACLES[name] = f"{HAND} SELECT id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM c"


def counted(cases: list[tuple[str, str]]) -> str:
    return "CAST(" + " + ".join(f"coalesce(({cond})::INT, 0)" for _, cond in cases) + " AS INT)"


by_hand("pol_rejection_reasons", reject_reasons=listed(*HAND_REJECTIONS), n_rejections=counted(HAND_REJECTIONS), n_hard_rejections=counted([r for r in HAND_REJECTIONS if r[1] != "NOT strict_icp"]))
by_hand("pol_prune_reasons", prune_reasons=listed(*HAND_PRUNE))
by_hand("pol_suspicious", suspicious=listed(*HAND_SUSPICIOUS), n_suspicious=counted(HAND_SUSPICIOUS))
policy_query("pol_completeness", "completeness", "contact_score", "report_contact_score")
by_hand("pol_completeness", completeness="complete", contact_score="sales_points", report_contact_score="report_points")
_hours = "CASE WHEN complete < 35 THEN 24 WHEN outreach >= 78 OR priority = 'A' THEN 72 ELSE 336 END"
by_hand("pol_due", enrichable="enrichable", refresh_hours=_hours, due=f"CASE WHEN NOT enrichable THEN '' WHEN never_enriched THEN 'never' WHEN hours_since_deep >= {_hours} THEN CASE WHEN complete < 35 THEN 'contactless_due' ELSE 'scheduled_due' END WHEN hours_since_deep >= 300 THEN 'rotation_due' ELSE '' END")
by_hand("pol_cleanup_reason", cleanup_reason="""CASE WHEN flat LIKE '%tradingview%' THEN 'tradingview_not_target_lead' WHEN regexp_matches(flat, 'payments\\.google\\.com|google payments|google pay') THEN 'payments_platform_noise'
  WHEN regexp_matches(flat, 'basketball-reference\\.com|basketball standings|nba standings') THEN 'sports_reference_noise' WHEN regexp_matches(flat, 'overleaf\\.com|latex templates') THEN 'document_template_noise'
  WHEN regexp_matches(flat, 'expo|conference|fair') AND regexp_matches(flat, 'exhibitor|booth list') THEN 'event_exhibitor_list_not_target' WHEN flat LIKE '%forex expo%' AND flat LIKE '%scribd.com%' THEN 'event_exhibitor_document_not_target' ELSE '' END""")
policy_query("pol_profile_paths", "path_head")
by_hand("pol_profile_paths", path_head="head")


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return register


_RANK = "CASE WHEN actionable_contact THEN 35 ELSE 0 END + contact_confidence + CASE WHEN has_best AND best_type <> ''website'' THEN 10 ELSE 0 END".replace("''", "'")


@query("pol_final_list", oracle(["id", "domain", "bucket"], ["export_ok", "actionable_contact"], "export_ok", f"QUALIFY row_number() OVER (PARTITION BY domain, path ORDER BY {_RANK} DESC, score DESC, id) = 1"))
def _(spark, d):
    """SUP-4: gate, order, one row of each address; the quota of a bucket follows with `limit_share`."""
    rows = POLICY.where(facts(spark, d), "export_ok", ["export_ok", "actionable_contact"])
    rows = O.first_per(rows.withColumn("_key", F.struct("domain", "path")), "_key", [F.expr(_RANK).desc(), F.desc("score"), F.asc("id")])
    return rows.select("id", "domain", "bucket")


_DUE_ORDER = "due_rank, CASE WHEN completeness < 35 THEN 0 ELSE 1 END, CASE WHEN priority = 'A' THEN 0 ELSE 1 END, CASE WHEN platform_rank = 0 THEN 0 ELSE 1 END, outreach DESC, platform_rank, completeness, score DESC, hours_since_deep DESC, id"


@query("pol_enrichment_order", oracle(["id", "due"], ["due_rank", "due", "completeness", "outreach", "platform_rank"], "due <> ''", f"ORDER BY {_DUE_ORDER} LIMIT 50"))
def _(spark, d):
    """SUP-8, SRT-6: what is due, in the order of nine keys; a work list of fifty."""
    rows = POLICY.where(facts(spark, d), "due <> ''", ["due_rank", "due", "completeness", "outreach", "platform_rank"])
    return rows.orderBy(*(F.expr(k.strip().removesuffix(" DESC")).desc() if k.endswith(" DESC") else F.expr(k.strip()).asc() for k in _DUE_ORDER.split(", "))).limit(50).select("id", "due")


@query("pol_commercial_rank", oracle(["id", "row_number() OVER (ORDER BY outreach DESC, contact_confidence DESC, score DESC, id) AS place"], ["outreach", "export_ok"], "export_ok"))
def _(spark, d):
    """SRT-5: exported leads by outreach score, confidence and score."""
    rows = POLICY.where(facts(spark, d), "export_ok", ["outreach", "export_ok"]).select("id", "outreach", "contact_confidence", "score")
    return O.ranked(rows, [F.desc("outreach"), F.desc("contact_confidence"), F.desc("score"), F.asc("id")], "place").select("id", "place")


@query("pol_audit_order", oracle(["id", "n_suspicious"], ["n_suspicious", "best_score"], "n_suspicious > 0", "ORDER BY best_score DESC, n_suspicious DESC, id LIMIT 100"))
def _(spark, d):
    """SRT-9: a report of the hundred most suspicious by score and number of reasons."""
    rows = POLICY.where(facts(spark, d), "n_suspicious > 0", ["n_suspicious", "best_score"])
    return rows.orderBy(F.desc("best_score"), F.desc("n_suspicious"), "id").limit(100).select("id", "n_suspicious")


@query("pol_column_sort", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name) DESC, p_partkey) AS place FROM part")
def _(spark, d):
    """SRT-10: a table sorted by one of its columns, either way, whatever the case."""
    return O.ranked(table(spark, d, "part"), [F.lower("p_name").desc(), F.asc("p_partkey")], "place").select("p_partkey", "place")


@query("pol_query_templates", f"""SELECT o_orderkey AS id FROM orders, (SELECT 1) WHERE NOT (regexp_matches(lower({_pick('best forex ib|expo exhibitors|which broker|funded account', 71, 4)}), '{DEMO["blocked_query"]}')
  OR regexp_matches(lower({_pick('best forex ib|expo exhibitors|which broker|funded account', 71, 4)}), '{DEMO["query_rank"]}')
  OR (regexp_matches(lower({_pick('best forex ib|expo exhibitors|which broker|funded account', 71, 4)}), '{DEMO["event_words"]}') AND regexp_matches(lower({_pick('best forex ib|expo exhibitors|which broker|funded account', 71, 4)}), '{DEMO["exhibitor_words"]}')))""")
def _(spark, d):
    """FLT-16, FLT-17: search templates that may run."""
    return facts(spark, d).filter(~blocked_query(POLICY, "query")).select("id")


_SEGMENTS = [("Event / Expo", r"(?i)\bexpo\b"), ("Fund / Asset Manager", r"(?i)fund manager"), ("Trading Education", r"(?i)\bacademy\b"), ("Community", r"(?i)\bcommunity\b")]


def _classify_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{label}'" for label, p in _SEGMENTS)
    first, last = POLICY.query("f0", ["segment_now"])
    second, end = POLICY.query("g", ["lead_type_now"])
    second = second.replace("p0 AS", "q0 AS")
    assert end == "p0" == last
    return f"""WITH {FACTS_SQL}, f0 AS (SELECT * REPLACE (CASE {cases} ELSE 'Unclear' END AS segment) FROM facts), {first}, g AS (SELECT * EXCLUDE (segment_now) REPLACE (segment_now AS segment) FROM p0), {second}
SELECT id, segment, lead_type_now AS lead_type, CASE WHEN score >= 76 THEN 'A' WHEN score >= 58 THEN 'B' WHEN score >= 38 THEN 'C' ELSE 'D' END AS priority FROM q0"""


@query("pol_classify", _classify_sql())
def _(spark, d):
    """PRJ-3: segment, kind of lead and priority of raw results."""
    return POLICY.classified(facts(spark, d), _SEGMENTS, F.col("score")).select("id", "segment", "lead_type", "priority")


policy_query("pol_search_signals", "synthetic", "query_intent")

#: SNK-5: the columns of a row that is ready for sales.
SALES_COLUMNS = ["best_score", "contact_score", "priority", "bucket", "best_type", "name", "url", "n_emails", "n_phones", "n_links", "n_websites", "n_makers", "snippet"]


@query("pol_sales_rows", oracle(["id", *SALES_COLUMNS], ["sales_gate", "contact_score", "best_score"], "sales_gate = ''"))
def _(spark, d):
    """SNK-5: rows ready for sales with the columns of their export."""
    return POLICY.where(facts(spark, d), "sales_gate = ''", ["sales_gate", "contact_score", "best_score"]).select("id", *SALES_COLUMNS)


_REACH = "n_emails > 0 OR n_forms > 0 OR n_phones > 0 OR has_best OR n_links > 0"
_HOT = "priority = 'A' OR (CASE WHEN commercial_score <> 0 THEN commercial_score ELSE score END) >= 76"


@query("flt_quick_views", f"WITH {FACTS_SQL} SELECT id, v AS quick FROM facts, (VALUES ('hot'), ('contactable'), ('no-contact'), ('')) q(v) WHERE CASE v WHEN 'hot' THEN {_HOT} WHEN 'contactable' THEN {_REACH} WHEN 'no-contact' THEN NOT ({_REACH}) ELSE true END")
def _(spark, d):
    """FLT-24: the rows of each quick view."""
    rows = facts(spark, d)
    hot, contact = V.is_hot("priority", "tier", "commercial_score", "score"), V.has_contact(rows, ["n_emails", "n_forms", "n_phones", "has_best", "n_links"])
    quick = F.array_compact(F.array(*(F.when(V.quick_view(v, hot, contact), v) for v in ("hot", "contactable", "no-contact", ""))))
    return rows.select("id", F.explode(quick).alias("quick"))


@query("snk_download_rows", "SELECT CAST(floor(c_acctbal) AS INT) || ',web,' || CASE WHEN c_acctbal > 5000 THEN 'A' ELSE 'B' END || ',,,' || c_mktsegment || ',new,\"' || c_name || ', \"\"x\"\"\",,' || c_mktsegment || '; en,https://' || c_custkey || '.example/,,,,,,,https://' || c_custkey || '.example/ -> /send (name; mail),,,,,,,' AS value FROM customer")
def _(spark, d):
    """SNK-6: customers as records of a download, as lines."""
    c = table(spark, d, "customer")
    url = F.concat(F.lit("https://"), F.col("c_custkey").cast("string"), F.lit(".example/"))
    form = F.array(F.struct(url.alias("page_url"), F.lit("/send").alias("action"), F.array(F.lit("name"), F.lit("mail")).alias("fields")))
    records = c.select(F.floor("c_acctbal").cast("int").alias("commercial_score"), F.lit("web").alias("bucket"), F.when(F.col("c_acctbal") > 5000, "A").otherwise("B").alias("priority"), F.col("c_mktsegment").alias("segment"), F.lit("new").alias("stage"), F.concat("c_name", F.lit(', "x"')).alias("name"), F.array("c_mktsegment", F.lit("en")).alias("languages"), url.alias("url"), form.alias("forms"))
    return csv_lines(V.download_rows(records))


@query("pol_dead_letters", "SELECT user_id, event_type, count(*) AS attempts, max(CAST(floor(value) AS INT)) AS last_value, count(*) >= 3 AS dead FROM events WHERE CAST(floor(value) AS INT) % 7 = 0 GROUP BY 1, 2")
def _(spark, d):
    """STM-8, SUP-9: failed work with its attempts; what failed often enough goes to the dead letters."""
    failed = table(spark, d, "events").filter(F.floor("value").cast("int") % 7 == 0)
    return O.dead_letters(failed, ["user_id", "event_type"], F.floor("value").cast("int"), most=3).select("user_id", "event_type", "attempts", F.col("last").alias("last_value"), "dead")


assert set(TEXTS) | set(NUMBERS) | set(FLAGS)
