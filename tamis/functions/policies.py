"""Lead policies: ordered rules over the facts of a record, as SQL conditions that a `Policy` turns into columns.

A fact is a column of the record (FACTS). Vocabularies are named patterns that the user supplies (PATTERNS lists the
names): `has(column, name)` in a rule asks whether the column's text holds one. Rules are kept apart from vocabularies,
in the order in which they count; `Policy` makes Spark columns of them, or plain SQL for another engine.

Cases: a null text holds nothing, a null number is 0, a null flag is false (`Policy.facts` sets these); a row on which no
rule of a first-match list holds gets its last label or the empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import normalize_space

#: Texts, numbers and flags that rules read. `text` is all visible text with names and addresses, `visible` the one that a
#: reader sees, `identity` names and addresses only, `query` the search that found the row. Contacts are counted after
#: cleaning: n_emails to n_makers; best_type is the kind of the best contact, owned_best and owned_email tell that it, or an
#: address, belongs to the platform, profile_best that it is the profile of the source, owned_links that links of the platform's are
#: still attached; n_direct counts direct outbound links, and direct_links has them, joined by blanks, after cleaning.
TEXTS = ("name", "title", "snippet", "url", "domain", "platform", "bucket", "segment", "lead_type", "priority", "source_intent", "qualification_status", "quality_status", "entity_type", "stage", "notes", "deep_status", "best_type", "country", "text", "visible", "identity", "query", "tier", "audience", "direct_links")
NUMBERS = ("score", "commercial_score", "contact_confidence", "n_emails", "n_phones", "n_forms", "n_links", "n_direct", "n_websites", "n_makers", "n_maker_links", "n_countries", "path_parts", "hours_since_deep", "hours_running", "hours_since_trail", "hours_since_gap")
FLAGS = ("owned_best", "owned_email", "has_best", "placeholder_email", "profile_best", "owned_links", "never_enriched", "manual_keep")

#: Names of the vocabularies, by what they are asked of.
PATTERNS = (
    "review", "review_path", "job", "directory", "broker_page", "prop_company", "official_prop", "review_domain", "decision_maker", "trading", "profile", "company_path", "contact", "partner_words",
    "strict_icp", "strong_trading", "partner_entity", "specialist_url", "social_platform", "allocator", "asset_context", "recruiter", "broker_identity", "broker_official", "official_domain", "searchable",
    "forum_page", "event_page", "directory_page", "direct_profile", "person_words", "generic_portal", "video_url", "export_noise", "education", "finance_media", "finance_trader", "broker_name", "market_page",
    "synthetic", "infra", "infra_domain", "cfd_context", "payments", "cfd_noise", "video_identity", "job_domain", "marketing", "farm_domain", "explainer", "reach_out", "software", "review_page", "bank_domain", "insurance", "news", "bad_media_domain", "finance_role", "consumer",
    "content_domain", "weak_name", "seller_profile", "prop_name", "prop_category", "partner_role", "broker_site", "social_noise", "target", "generic_page", "reference_site", "malformed_title", "broker_noise", "insider", "actual_signal", "finance_noise", "specialist_words", "trusted_bucket", "research_signal",
    "exchange_domain", "false_positive_domain", "press", "cache_page", "telegram_page", "social_directory", "social_words", "platform_page", "platform_noise", "factory", "factory_words", "market_words", "market_own", "prunable", "latin", "blocked_query", "query_rank", "event_words", "exhibitor_words", "smart_noise", "trail_noise", "identity_trading", "ui_noise", "ui_explainer", "intent",
    "article", "learning_path", "explainer_path", "explainer_contact", "marketing_domain", "payments_trading", "audit_icp",
    "bad_terms", "hot_segment", "recruiting_segment", "own_profile", "decision_link", "company_link", "whatsapp", "booking", "telegram", "instagram", "linkedin",
)

#: The reasons of rejection, in order, with what each asks.
REJECTION = [
    ("synthetic search snippet without visible ICP evidence", "has(snippet, synthetic) AND NOT has(visible, strict_icp)"),
    ("platform/help/widget/infra result", "has(text, infra) OR has(domain, infra_domain)"),
    ("official broker/brokerage page", "official_broker"),
    ("missing strict forex/CFD/trading ICP signal", "NOT strict_icp"),
    ("non-trading .cfd domain/page", "domain LIKE '%.cfd' AND NOT has(visible, cfd_context)"),
    ("payments/money-transfer page, not trading ICP", "has(visible, payments) AND NOT has(visible, payments_trading)"),
    ("non-trading CFD/acronym noise", "has(text, cfd_noise) AND NOT has(text, cfd_context)"),
    ("legacy YouTube result without trading identity", "has(url, video_url) AND has(snippet, synthetic) AND NOT has(identity, video_identity)"),
    ("job listing/careers page", "has(domain, job_domain) OR has(text, job)"),
    ("generic market/chart page", "has(url, market_page)"),
    ("generic social-media/marketing page", "(has(domain, marketing_domain) OR has(text, marketing)) AND NOT strong_trading"),
    ("generic article/reference page", "has(domain, farm_domain)"),
    ("generic explainer/reference page", "(has(text, explainer) OR has(text, explainer_path)) AND NOT has(text, explainer_contact)"),
    ("non-trading business software page", "has(text, software)"),
    ("generic article/reference page", "has(text, article) AND NOT has(domain, farm_domain) AND (NOT partner_entity OR has(text, learning_path))"),
    ("generic ranking/review page", "(has(domain, review_domain) OR has(text, review_page)) AND NOT has(text, reach_out)"),
    ("generic bank/asset-management institution page", "has(domain, bank_domain) AND NOT (strong_trading AND partner_entity)"),
    ("insurance broker, not trading broker", "has(text, insurance) AND NOT strong_trading"),
    ("generic news/government result", "has(text, news) AND NOT strong_trading"),
    ("generic non-forex broker/media page", "has(domain, bad_media_domain) AND NOT strong_trading"),
    ("generic finance analyst/media result", "has(text, finance_role) AND NOT strong_trading"),
    ("consumer/sports/forum noise", "has(text, consumer)"),
]

#: The reason that exports leave to the ICP gate.
ICP_REASON = "missing strict forex/CFD/trading ICP signal"

#: Signals that rules share, each after those that it reads. CLS-14, SUP-1, SUP-3, SUP-15, FLT-10, FLT-16.
SIGNALS = [
    ("strong_trading", "has(text, strong_trading)"),
    ("partner_entity", "has(text, partner_entity)"),
    ("specialist", "has(url, specialist_url) OR has(platform, specialist_url)"),
    ("strict_icp", "specialist OR has(visible, strict_icp) OR (has(platform, social_platform) AND has(text, strict_icp)) OR (has(visible, allocator) AND has(visible, asset_context)) OR (lead_type = 'recruitment' AND has(visible, recruiter) AND has(visible, broker_identity))"),
    ("official_broker", "lead_type <> 'recruitment' AND (has(domain, official_domain) OR (has(text, broker_identity) AND has(text, broker_official)))"),
    ("searchable", "strong_trading OR has(text, searchable)"),
    ("validated_contact", "has_best OR n_emails > 0 OR n_forms > 0 OR n_direct > 0 OR n_makers > 0 OR n_maker_links > 0"),
    ("actionable_contact", "n_emails > 0 OR n_forms > 0 OR n_phones > 0 OR n_links > 0 OR (has_best AND best_type <> 'website' AND NOT owned_best)"),
    ("real_contact", "NOT owned_email AND actionable_contact"),
    ("decision_contact", "NOT owned_email AND (actionable_contact OR contact_confidence >= 90)"),
    ("owned_decision_contact", "n_emails > 0 OR n_phones > 0 OR n_forms > 0 OR n_links > 0 OR (has_best AND best_type NOT IN ('', 'website'))"),
    ("decision_path", "n_makers > 0 OR n_maker_links > 0"),
    ("website_only", "NOT real_contact AND (best_type = 'website' OR n_websites > 0)"),
    ("direct_profile", "has(url, direct_profile)"),
    ("forum_page", "has(url, forum_page) OR has(domain, forum_page)"),
    ("event_page", "NOT has(url, linkedin) AND (has(text, event_page) OR has(url, event_page))"),
    ("directory_page", "(has(text, directory_page) OR has(url, directory_page)) AND NOT direct_profile"),
    ("company_or_person", "direct_profile OR (validated_contact AND has(text, person_words)) OR (validated_contact AND segment IN ('IB / Partner', 'Affiliate', 'Trading Education', 'Community', 'Creator / Influencer', 'Prop / Funded Trading', 'Fund / Asset Manager', 'High-Calibre Trader'))"),
    ("generic_portal", "has(text, generic_portal) OR has(url, generic_portal)"),
    ("synthetic", "has(snippet, synthetic)"),
    ("query_intent", "has(query, intent) AND has(query, searchable)"),
    ("contact_first", "bucket IN ('tradingview', 'mql5', 'myfxbook', 'specialist', 'forum') OR generic_portal"),
    ("best_score", "CASE WHEN commercial_score > 0 THEN commercial_score ELSE score END"),
    ("prop_firm", "has(domain, official_prop) OR entity_type = 'prop_firm_company' OR has(text, prop_name) OR (has(text, prop_category) AND NOT has(text, partner_role))"),
    ("target", "has(text, target)"),
    ("blocked", "prop_firm OR entity_type IN ('review_or_seo', 'job_posting', 'directory_or_registry', 'broker_page') OR segment = 'Broker Site' OR has(text, broker_site) OR (has(text, social_noise) AND NOT target) OR (has(text, generic_page) AND best_score < 72 AND NOT target) OR (has(text, review) AND NOT has(text, reach_out)) OR (best_score < 45 AND NOT target)"),
    ("contact_points", "(CASE WHEN n_emails > 0 THEN 24 ELSE 0 END) + (CASE WHEN n_forms > 0 THEN 14 ELSE 0 END) + (CASE WHEN n_direct > 0 THEN 16 ELSE 0 END) + (CASE WHEN n_phones > 0 THEN 14 ELSE 0 END) + (CASE WHEN has_best THEN 18 ELSE 0 END) + (CASE WHEN n_makers > 0 THEN 14 ELSE 0 END) + (CASE WHEN n_maker_links > 0 THEN 10 ELSE 0 END)"),
    ("source_only", "bucket IN ('mql5', 'myfxbook', 'tradingview', 'specialist', 'forum') AND contact_points <= 0 AND n_websites = 0"),
    ("best_real", "has_best AND best_type <> 'website' AND NOT owned_best AND NOT profile_best"),
    ("completeness", "(CASE WHEN n_emails > 0 THEN 30 ELSE 0 END) + (CASE WHEN n_phones > 0 THEN 20 ELSE 0 END) + (CASE WHEN n_forms > 0 THEN 20 ELSE 0 END) + (CASE WHEN n_websites > 0 THEN 10 ELSE 0 END) + (CASE WHEN n_makers > 0 THEN 20 ELSE 0 END) + (CASE WHEN n_maker_links > 0 THEN 15 ELSE 0 END) + (CASE WHEN n_links > 0 THEN 10 ELSE 0 END) + (CASE WHEN has_best THEN 25 ELSE 0 END)"),
    ("routes", "(CASE WHEN has(direct_links, whatsapp) THEN 40 ELSE 0 END) + (CASE WHEN has(direct_links, telegram) THEN 35 ELSE 0 END) + (CASE WHEN n_emails > 0 THEN 30 ELSE 0 END) + (CASE WHEN n_phones > 0 THEN 25 ELSE 0 END) + (CASE WHEN n_forms > 0 THEN 18 ELSE 0 END)"),
    ("contact_score", "routes + (CASE WHEN n_websites > 0 THEN 5 ELSE 0 END) + (CASE WHEN decision_path THEN 15 ELSE 0 END) + (CASE WHEN best_real THEN 20 ELSE 0 END)"),
    ("report_contact_score", "routes + (CASE WHEN n_websites > 0 THEN 10 ELSE 0 END) + (CASE WHEN decision_path THEN 20 ELSE 0 END) + (CASE WHEN has_best THEN 20 ELSE 0 END)"),
    ("decision_real", "n_emails > 0 OR n_phones > 0 OR n_forms > 0 OR n_direct > 0 OR best_real"),
    ("path_head", "lower(split_part(split_part(split_part(url, '/', 4), '?', 1), '#', 1))"),
    ("text_and_bucket", "lower(concat(text, ' ', bucket))"),
    # The visible text without the search that found it.
    ("visible_own", "CASE WHEN query <> '' AND instr(visible, query) > 0 THEN concat(substr(visible, 1, instr(visible, query) - 1), substr(visible, instr(visible, query) + length(query))) ELSE visible END"),
]

#: CLS-8: kinds of entity, the first that holds; the last without any.
ENTITY = [
    ("job_posting", "has(text, job)"),
    ("review_or_seo", "has(domain, review_domain) OR (has(text, review) AND NOT has(text, decision_maker) AND NOT entity_contact) OR has(url, review_path)"),
    ("directory_or_registry", "has(text, directory) AND NOT has(text, decision_maker) AND NOT entity_contact"),
    ("prop_firm_company", "has(domain, official_prop) OR has(text, prop_company)"),
    ("decision_maker", "has(text, decision_maker) AND entity_trading"),
    ("social_profile", "has(text, profile) AND entity_trading"),
    ("capital_allocator", "segment = 'Fund / Asset Manager'"),
    ("partner_entity", "segment IN ('Trading Education', 'Community', 'Creator / Influencer', 'IB / Partner', 'Affiliate')"),
    ("company", "entity_trading AND (entity_contact OR has(url, company_path))"),
    ("broker_page", "has(text, broker_page) AND segment = 'Broker Site'"),
    ("research_candidate", "TRUE"),
]
ENTITY_SIGNALS = [
    ("Official prop firm", "has(domain, official_prop)"),
    ("Decision maker", "has(text, decision_maker)"),
    ("Contact path", "entity_contact"),
    ("Trading ICP", "entity_trading"),
    ("Public profile", "has(text, profile)"),
    ("Company/partner path", "has(url, company_path)"),
]
#: What the kinds are worth, and the kinds that are turned down.
ENTITY_BASE = {"prop_firm_company": 58, "decision_maker": 64, "partner_entity": 56, "social_profile": 48, "capital_allocator": 54, "company": 50, "research_candidate": 28, "review_or_seo": 5, "job_posting": 4, "directory_or_registry": 10, "broker_page": 8}
ENTITY_REJECTED = ("review_or_seo", "job_posting", "directory_or_registry", "broker_page")

#: CLS-11: why a record is a source or a lead; the first two letters of the kind's words follow from it.
KIND = [
    ("forum_thread_or_index", "forum_page"),
    ("event_or_sponsor_page", "event_page"),
    ("directory_or_index_page", "directory_page"),
    ("source_bucket_without_validated_contact", "bucket IN ('forum', 'ecosystem') AND NOT validated_contact"),
    ("direct_profile_or_validated_contact", "company_or_person"),
    ("default_contactable_or_profile_candidate", "TRUE"),
]

#: FLT-7: what a record for export must pass; the first gate that it fails is its reason.
EXPORT_GATES = [
    ("address", "url <> '' AND platform <> ''"),
    ("not video", "platform <> 'YouTube' AND NOT has(url, video_url)"),
    ("score", "score >= 50"),
    ("priority", "priority <> 'D'"),
    ("not a broker's site", "segment <> 'Broker Site'"),
    ("not rejected", "n_rejections = 0"),
    ("trading ICP", "strict_icp"),
    ("contact", "actionable_contact"),
    ("actual lead", "actual_lead"),
    ("not a portal", "NOT generic_portal"),
    ("lead type", "lead_type IN ('partner', 'recruitment', 'institution')"),
    ("no export noise", "NOT has(text, export_noise)"),
    ("education of traders", "NOT has(text, education) OR has(text, finance_trader)"),
    ("no finance media", "NOT has(text, finance_media) OR has(text, finance_trader)"),
    ("no broker's name", "lead_type = 'recruitment' OR NOT has(name, broker_name)"),
]

#: FLT-8: the work list.
WORKING_GATES = [
    ("address", "url <> '' AND platform <> '' AND domain <> ''"),
    ("no reference site", "NOT has(domain, reference_site) AND NOT has(url, reference_site)"),
    ("not video", "platform <> 'YouTube' AND NOT has(url, video_url)"),
    ("no market page", "NOT has(url, market_page)"),
    # Hosts whose root or whose pages of these paths are nobody's.
    ("a path on profile hosts", "NOT (((domain = 'forexfactory.com' OR domain LIKE '%.forexfactory.com') AND path_head = '') OR ((domain = 'reddit.com' OR domain LIKE '%.reddit.com') AND path_head NOT IN ('user', 'u')) OR ((domain = 'instagram.com' OR domain LIKE '%.instagram.com') AND path_head IN ('p', 'reel', 'reels', 'stories', 'explore')) OR (domain IN ('x.com', 'twitter.com') AND path_head IN ('i', 'share', 'intent', 'search', 'home')))"),
    ("not a broker's site", "segment <> 'Broker Site'"),
    ("priority", "NOT (priority = 'D' AND score < 45)"),
    ("lead type", "lead_type IN ('partner', 'recruitment', 'institution') OR qualification_status = 'research_candidate'"),
    ("not rejected", "n_hard_rejections = 0"),
    ("actual lead", "actual_lead"),
    ("proper name", "NOT has(name, malformed_title) AND NOT has(title, malformed_title)"),
    ("no broker's noise", "NOT has(text, broker_noise) OR has(text, insider)"),
    ("no finance noise", "NOT has(text, finance_noise) OR strong_trading"),
    ("trading signal", "has(text, actual_signal) OR (bucket IN ('mql5', 'myfxbook', 'tradingview', 'specialist', 'forum') AND has(text, specialist_words))"),
    ("not a portal", "NOT generic_portal"),
    ("contact or maker", "NOT contact_first OR actionable_contact OR decision_path"),
    ("score or trusted source", "best_score >= 35 OR has(bucket, trusted_bucket)"),
]

#: FLT-9: sources worth research.
RESEARCH_GATES = [
    ("address", "url <> '' AND platform <> ''"),
    ("research source", "NOT actual_lead"),
    ("not a broker's site", "segment <> 'Broker Site'"),
    ("priority", "NOT (priority = 'D' AND score < 45)"),
    ("not rejected", "n_hard_rejections = 0"),
    ("signal", "strict_icp OR searchable OR has(text, research_signal)"),
    ("score or source", "score >= 45 OR bucket IN ('forum', 'ecosystem', 'specialist')"),
]

#: FLT-5, FLT-6: what the two lists on screen show.
API_GATES = [
    ("something to show", "url <> '' OR name <> '' OR title <> ''"),
    ("not blocked", "NOT blocked"),
    ("not a broker's site", "segment <> 'Broker Site'"),
    ("not put away", "lower(quality_status) NOT IN ('rejected', 'trash', 'archive')"),
    ("score or type", "best_score >= 38 OR qualification_status = 'research_candidate' OR lead_type IN ('partner', 'recruitment', 'institution')"),
]
SNAPSHOT_GATES = [
    ("something to show", "url <> '' AND (name <> '' OR title <> '')"),
    ("not blocked", "NOT blocked"),
    ("not a broker's site", "segment <> 'Broker Site'"),
    ("priority", "priority <> 'D'"),
    ("score", "score >= 45 OR commercial_score >= 45"),
    ("no noise", "NOT has(text, ui_noise)"),
    ("no explainer", "NOT has(text, ui_explainer)"),
    ("some list takes it", "export_ok OR working_ok OR commercial_score >= 58"),
]

#: FLT-28: ready for sales; first what is wrong.
SALES_GATES = [
    ("qualified", "export_ok"),
    ("own address", "NOT owned_email OR has_best"),
    ("contact of a specialist", "NOT (bucket IN ('mql5', 'myfxbook', 'specialist') AND contact_score < 55)"),
    ("contact", "contact_score >= 45"),
]

# Fixed values.
#: FLT-12: reasons to prune after those of rejection, all that hold.
PRUNE = [
    ("commercial noise policy", "blocked"),
    ("platform/help/widget/infra domain", "has(domain, infra_domain)"),
    ("known non-lead/content/government domain", "has(domain, content_domain) AND NOT has(visible, strict_icp)"),
    ("synthetic search snippet inflated lead", "has(snippet, synthetic) AND best_score >= 60"),
    ("weak/generic identity with high score", "has(name, weak_name) AND best_score >= 75"),
    ("placeholder/platform email contamination", "placeholder_email OR owned_email"),
    ("best contact is platform-owned URL", "has_best AND owned_best"),
    ("high-score lead without real decision contact", "best_score >= 75 AND NOT owned_decision_contact"),
    ("content/community lead without contact route", "bucket IN ('forum', 'reddit', 'web') AND best_score >= 70 AND NOT owned_decision_contact"),
    ("discord/community lead without contact route", "bucket = 'discord' AND best_score >= 65 AND NOT owned_decision_contact"),
    ("query-driven social result", "bucket IN ('linkedin', 'instagram', 'tiktok', 'x', 'facebook') AND has(snippet, synthetic)"),
    ("platform strategy profile without owned contact route", "bucket IN ('fxblue', 'zulutrade', 'specialist') AND NOT owned_decision_contact AND has(url, specialist_url)"),
    ("YouTube lead without contact route", "has(url, video_url) AND NOT owned_decision_contact"),
    ("weak/contaminated YouTube lead", "has(url, video_url) AND (NOT has(visible, strict_icp) OR owned_email)"),
    ("high score without visible ICP evidence", "NOT has(visible, strict_icp) AND best_score >= 85 AND NOT has(url, seller_profile)"),
    ("insufficient lead evidence text", "length(text) < 18"),
]

#: FLT-13, SUP-14: the first reason why a record is noise.
NOISE = [
    ("commercial_noise_policy", "blocked"),
    ("known_currency_exchange_false_positive", "has(domain, exchange_domain)"),
    ("known_generic_false_positive", "has(domain, false_positive_domain)"),
    ("generic_article_or_press_release", "has(text, press) OR has(url, press)"),
    ("generic_cache_page", "has(url, cache_page)"),
    ("tradingview_chart_or_market_page", "has(url, market_page)"),
    ("official_telegram_page", "has(text, telegram_page)"),
    ("generic_social_or_directory_page", "has(url, social_directory) AND NOT has(text, social_words)"),
    ("generic_platform_page", "has(text, platform_page)"),
    ("non_financial_platform_noise", "has(text, platform_noise)"),
    ("reference_content_page", "has(text, reference_site)"),
    ("forexfactory_generic_page", "has(text, factory) AND NOT has(text, factory_words)"),
    ("mql5_market_generic_page", "has(text, market_words) AND NOT has(text, market_own)"),
    ("tradingview_source_only_noise", "bucket = 'tradingview' AND NOT (has_best OR n_emails > 0 OR n_forms > 0 OR n_direct > 0) AND NOT has(url, own_profile)"),
]

# Fixed values.
#: FLT-14: more of what is cleaned up, over text and bucket as one text; the first that holds.
CLEANUP = [
    ("tradingview_not_target_lead", "contains(text_and_bucket, 'tradingview')"),
    ("payments_platform_noise", "contains(text_and_bucket, 'payments.google.com') OR contains(text_and_bucket, 'google payments') OR contains(text_and_bucket, 'google pay')"),
    ("sports_reference_noise", "contains(text_and_bucket, 'basketball-reference.com') OR contains(text_and_bucket, 'basketball standings') OR contains(text_and_bucket, 'nba standings')"),
    ("document_template_noise", "contains(text_and_bucket, 'overleaf.com') OR contains(text_and_bucket, 'latex templates')"),
    ("event_exhibitor_list_not_target", "(contains(text_and_bucket, 'expo') OR contains(text_and_bucket, 'conference') OR contains(text_and_bucket, 'fair')) AND (contains(text_and_bucket, 'exhibitor') OR contains(text_and_bucket, 'booth list'))"),
    ("event_exhibitor_document_not_target", "contains(text_and_bucket, 'forex expo') AND contains(text_and_bucket, 'scribd.com')"),
]

#: FLT-15: why a new record isn't stored.
DISCARD = [
    ("blocked_commercial_noise", "blocked"),
    ("hard_rejected", "n_rejections > 0"),
    ("classification_rejected", "qualification_status = 'rejected'"),
    ("commercially_rejected", "quality_status = 'rejected' OR commercial_score < 28"),
    ("commercial_score_below_threshold", "best_score < 42"),
]

#: CLS-3: the kind of lead, from signals in the text and the intent of the search.
LEAD_TYPE = [
    ("partner", "source_intent IN ('intent', 'forum') OR has(text, intent)"),
    ("institution", "source_intent = 'specialist' AND has(text, allocator)"),
    ("partner", "source_intent = 'specialist'"),
    ("recruitment", "source_intent = 'social' AND has(text, recruiter) AND has(text, broker_identity)"),
    ("partner", "source_intent = 'social'"),
    ("institution", "source_intent = 'ecosystem' AND has(text, allocator)"),
    ("partner", "source_intent = 'ecosystem' OR has(text, event_words) OR has(text, prop_category) OR has(text, education)"),
    ("recruitment", "source_intent = 'recruitment' AND (has(text, recruiter) OR has(text, broker_identity))"),
    ("recruitment", "has(text, recruiter) AND has(text, broker_identity) AND NOT has(text, partner_role)"),
    ("institution", "has(text, allocator)"),
    ("partner", "has(text, partner_words) OR segment <> 'Unclear'"),
    ("research", "TRUE"),
]

#: CLS-2: the segment where the search's intent or the source overrides it; null where it stays.
SEGMENT_OVERRIDE = [
    ("Broker-Seeking / Intent Post", "source_intent IN ('intent', 'forum') AND (has(text, intent) OR has(query, intent))"),
    ("Trading Education", "source_intent = 'social' AND segment = 'Unclear' AND (has(text, education) OR has(query, education))"),
    ("Community", "source_intent = 'social' AND segment = 'Unclear' AND (has(text, social_words) OR has(query, social_words))"),
    ("Creator / Influencer", "source_intent = 'social' AND segment = 'Unclear'"),
    ("Prop / Funded Trading", "source_intent = 'specialist' AND segment = 'Unclear' AND (has(text, specialist_words) OR has(query, specialist_words))"),
    ("Fund / Asset Manager", "source_intent = 'specialist' AND segment = 'Unclear' AND (has(text, allocator) OR has(query, allocator))"),
    ("IB / Partner", "source_intent = 'specialist' AND segment = 'Unclear'"),
    ("Unclear", "segment = 'Event / Expo' AND source_intent <> 'ecosystem' AND NOT has(identity, event_words) AND NOT has(query, event_words)"),
]

#: CLS-13: the way to reach someone, what to offer, how likely someone decides, and how strong the contact is.
CHANNEL = [
    ("Email", "n_emails > 0"),
    ("WhatsApp", "has(identity, whatsapp) OR n_phones > 0"),
    ("Calendly", "has(identity, booking)"),
    ("LinkedIn", "n_maker_links > 0 OR has(identity, linkedin)"),
    ("Telegram", "has(identity, telegram)"),
    ("Instagram", "has(identity, instagram)"),
    ("Contact form", "n_forms > 0"),
    ("Website research", "n_websites > 0"),
    ("Source URL", "TRUE"),
]
PLAY = [
    ("Recruitment / senior BD hire", "has(segment, recruiting_segment) OR lead_type = 'recruitment'"),
    ("Hot intent: broker selection conversation", "segment = 'Broker-Seeking / Intent Post'"),
    ("IB / revenue-share partnership", "segment = 'IB / Partner'"),
    ("Affiliate / CPL-CPA-revshare partnership", "segment = 'Affiliate'"),
    ("Academy sponsorship + IB funnel", "segment = 'Trading Education'"),
    ("Community activation + broker partnership", "segment = 'Community'"),
    ("Creator sponsorship + affiliate funnel", "segment = 'Creator / Influencer'"),
    ("Expo/event follow-up and partnership mapping", "segment = 'Event / Expo'"),
    ("Prop/funded trader audience partnership", "segment = 'Prop / Funded Trading'"),
    ("Institutional liquidity/CFD relationship", "segment = 'Fund / Asset Manager'"),
    ("Fintech/payment ecosystem partnership", "segment = 'Fintech / Payments'"),
    ("Institutional partnership research", "lead_type = 'institution'"),
    ("Partner research", "TRUE"),
]
LIKELIHOOD = [
    ("High", "(n_makers > 0 AND has(text, decision_maker)) OR has(identity, decision_link)"),
    ("Medium", "n_maker_links > 0 OR has(text, decision_maker) OR has(identity, company_link)"),
    ("Low", "TRUE"),
]
STRENGTH = [
    ("strong", "n_emails > 0 OR n_phones > 0 OR n_forms > 0 OR n_maker_links > 0"),
    ("direct", "has(identity, own_profile)"),
    ("source-only", "bucket IN ('mql5', 'myfxbook', 'forum', 'ecosystem', 'web')"),
    ("direct", "n_links > 0"),
    ("none", "TRUE"),
]
#: What is done next, by channel; recruitment has its own.
NEXT_ACTION = [
    ("'Contactar no LinkedIn com abordagem de carreira BD LatAm'", "lead_type = 'recruitment' AND channel = 'LinkedIn'"),
    ("'Validar senioridade e abrir conversa de recrutamento BD'", "lead_type = 'recruitment'"),
    ("concat('Enviar email curto com proposta: ', play)", "channel = 'Email'"),
    ("concat('Enviar WhatsApp direto com pitch de parceria: ', play)", "channel = 'WhatsApp'"),
    ("concat('Adicionar/DM decision maker com angulo: ', play)", "channel = 'LinkedIn'"),
    ("concat('Submeter formulario pedindo call de parceria: ', play)", "channel = 'Contact form'"),
    ("'Abrir site, confirmar owner/BD e procurar email/LinkedIn antes do outreach'", "channel = 'Website research'"),
    ("'Abrir fonte, validar contexto e contactar pelo canal disponivel'", "TRUE"),
]

#: PRJ-5: reasons for and flags against, all that hold, the first eight and six count.
QUALIFICATION = [
    ("Priority A from source scoring", "priority = 'A'"),
    ("High relevance score", "score >= 85"),
    ("Strong segment", "has(segment, hot_segment)"),
    ("Email available", "n_emails > 0"),
    ("Phone/WhatsApp style contact available", "n_phones > 0"),
    ("Contact/partner form available", "n_forms > 0"),
    ("Direct social/contact path available", "n_links > 0"),
    ("Broker/partnership intent signal found", "has(text, intent)"),
    ("Audience signal", "audience <> ''"),
    ("Decision-maker/company path found", "decision_path"),
]
RED_FLAGS = [
    ("No direct contact path yet", "n_emails = 0 AND n_forms = 0 AND n_links = 0 AND n_direct = 0"),
    ("Lower relevance score", "score < 65"),
    ("Official broker site rather than partner lead", "segment = 'Broker Site'"),
    ("Generic/reference-market result risk", "has(text, bad_terms)"),
    ("Country not confirmed", "country IN ('', 'Unknown')"),
]

#: SUP-7, STM-4, STM-5: why a record's enrichment is due; the first that holds. Hours are parameters of `Policy`.
DUE = [
    ("", "NOT enrichable"),
    ("never", "never_enriched"),
    ("contactless_due", "hours_since_deep >= refresh_hours AND completeness < 35"),
    ("scheduled_due", "hours_since_deep >= refresh_hours"),
    ("rotation_due", "hours_since_deep >= rotation_hours"),
    ("", "TRUE"),
]

# Fixed values.
#: CLS-16: what an audit finds suspicious, all that hold. Addresses that are placeholders are not listed.
SUSPICIOUS = [
    ("placeholder/generic emails", "placeholder_email"),
    ("platform-owned email still present", "owned_email"),
    ("bestContact is the source/platform profile", "has_best AND profile_best"),
    ("bestContact is platform/widget/infra-owned URL", "has_best AND owned_best"),
    ("high-score lead without real decision contact", "best_score >= 75 AND NOT decision_real"),
    ("high-score lead without actual ICP terms in result/profile text", "best_score >= 75 AND NOT has(visible, audit_icp)"),
    ("score likely inflated by synthetic search snippet", "best_score >= 75 AND has(snippet, synthetic)"),
    ("generic or weak identity/title", "best_score >= 75 AND has(name, weak_name)"),
    ("social profile appears query-driven, not profile-driven", "bucket IN ('linkedin', 'instagram', 'tiktok', 'x', 'facebook') AND best_score >= 75 AND NOT has(identity, audit_icp) AND NOT has(visible_own, audit_icp)"),
    ("specialist/platform lead has weak contact score", "bucket IN ('mql5', 'myfxbook', 'fxblue', 'zulutrade', 'specialist') AND contact_score < 45 AND best_score >= 75"),
    ("platform-owned links still attached", "owned_links"),
    ("website-only route, not execution-ready", "n_websites > 0 AND NOT decision_real"),
]


def first_of(rules: list[tuple[str, str]], default: str = "''", quoted: bool = True) -> str:
    cases = " ".join(f"WHEN {cond} THEN " + (f"'{_q(label)}'" if quoted else label) for label, cond in rules)
    return f"CASE {cases} ELSE {default} END"


def all_of(rules: list[tuple[str, str]]) -> str:
    """The labels that hold, in order, joined by "; "; a text is the same in every engine."""
    parts = ", ".join(f"CASE WHEN {cond} THEN '{_q(label)}' END" for label, cond in rules)
    return f"concat_ws('; ', {parts})"


def count_of(rules: list[tuple[str, str]]) -> str:
    return " + ".join(f"(CASE WHEN {cond} THEN 1 ELSE 0 END)" for _, cond in rules)


def gate(rules: list[tuple[str, str]]) -> str:
    """The first gate that a row doesn't pass; empty if it passes all."""
    return first_of([(label, f"NOT ({cond})") for label, cond in rules])


def _q(text: str) -> str:
    return text.replace("'", "''")


def steps(hours: tuple[int, int, int, int] = (1, 1, 6, 2)) -> list[tuple[str, str]]:
    """Every derived column after those that it reads. hours: until a record is due again without contact, when hot, else,
    and at most."""
    contactless, hot, other, rotation = hours
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ENTITY_BASE.items())
    rejected = ", ".join(f"'{k}'" for k in ENTITY_REJECTED)
    tier = "CASE WHEN {0} >= 82 THEN 'A' WHEN {0} >= 66 THEN 'B' WHEN {0} >= 48 THEN 'C' ELSE 'D' END"
    entity_score = f"""(CASE entity {weights} ELSE 20 END) + least(18.0, score * 0.18) + (CASE WHEN n_emails > 0 THEN 12 ELSE 0 END) + (CASE WHEN n_forms > 0 THEN 8 ELSE 0 END)
      + (CASE WHEN n_direct > 0 THEN 10 ELSE 0 END) + (CASE WHEN contact_confidence >= 75 THEN 10 WHEN contact_confidence >= 50 THEN 5 ELSE 0 END) + (CASE WHEN has(text, decision_maker) THEN 10 ELSE 0 END)
      + (CASE WHEN has(url, company_path) THEN 8 ELSE 0 END) + (CASE WHEN has(text, partner_words) THEN 12 ELSE 0 END) + (CASE WHEN has(text, contact) THEN 6 ELSE 0 END) + (CASE WHEN has(domain, official_prop) THEN 10 ELSE 0 END)
      - (CASE WHEN entity IN ({rejected}) THEN 45 ELSE 0 END) - (CASE WHEN has(text, review) AND NOT has(text, contact) THEN 20 ELSE 0 END) - (CASE WHEN has(text, job) THEN 30 ELSE 0 END)"""
    outreach = """(CASE lead_type WHEN 'partner' THEN 25 WHEN 'institution' THEN 22 WHEN 'recruitment' THEN 14 ELSE 0 END) + (CASE WHEN bucket IN ('linkedin', 'instagram', 'x', 'telegram') THEN 20 ELSE 0 END)
      + (CASE WHEN bucket IN ('myfxbook', 'mql5', 'specialist') THEN CASE WHEN contact_points > 0 THEN 12 ELSE 2 END WHEN bucket = 'tradingview' AND contact_points > 0 THEN 6 ELSE 0 END)
      + (CASE WHEN n_emails > 0 THEN 20 ELSE 0 END) + (CASE WHEN n_forms > 0 THEN 12 ELSE 0 END) + (CASE WHEN n_direct > 0 THEN 12 ELSE 0 END) + (CASE WHEN n_makers > 0 THEN 12 ELSE 0 END)
      + (CASE WHEN has(country, latin) OR has(snippet, latin) OR has(name, latin) THEN 8 ELSE 0 END) + least(25.0, score / 4.0) - (CASE WHEN bucket = 'mql5' AND contact_points <= 0 THEN 18 ELSE 0 END)
      - (CASE WHEN bucket = 'tradingview' THEN CASE WHEN contact_points > 0 THEN 8 ELSE 25 END ELSE 0 END) - (CASE WHEN source_only THEN 30 ELSE 0 END) - (CASE WHEN generic_portal OR has(url, market_page) THEN 40 ELSE 0 END)
      + (CASE WHEN priority = 'A' THEN CASE WHEN contact_points > 0 THEN 10 ELSE -10 END WHEN priority = 'D' THEN -20 ELSE 0 END)"""
    rank = "CASE {0} WHEN 'A1 Hot' THEN 3 WHEN 'A2 Strong' THEN 2 WHEN 'B Nurture' THEN 1 ELSE 0 END"
    return [
        *SIGNALS,
        ("reject_reasons", all_of(REJECTION)),
        ("n_rejections", count_of(REJECTION)),
        ("n_hard_rejections", count_of([r for r in REJECTION if r[0] != ICP_REASON])),
        ("kind_reason", first_of(KIND)),
        ("actual_lead", "kind_reason IN ('direct_profile_or_validated_contact', 'default_contactable_or_profile_candidate')"),
        ("entity_contact", "has(text, contact) OR n_emails > 0 OR n_forms > 0 OR n_direct > 0"),
        ("entity_trading", "has(text, trading) OR has(domain, official_prop)"),
        ("entity", first_of(ENTITY)),
        ("entity_signals", all_of(ENTITY_SIGNALS)),
        ("entity_score", f"CAST(least(100, greatest(0, floor({entity_score} + 0.5))) AS INT)"),
        ("entity_tier", tier.format("entity_score")),
        ("entity_quality", f"CASE WHEN entity IN ({rejected}) THEN 'rejected' WHEN entity_score >= 42 THEN 'qualified' ELSE 'manual_review' END"),
        ("commercially_rejected", "entity_quality = 'rejected' OR entity_score < 28"),
        ("outreach", f"CAST(least(100, greatest(0, floor({outreach} + 0.5))) AS INT)"),
        ("export_gate", gate(EXPORT_GATES)),
        ("export_ok", "export_gate = ''"),
        ("working_gate", gate(WORKING_GATES)),
        ("working_ok", "working_gate = ''"),
        ("research_gate", gate(RESEARCH_GATES)),
        ("api_gate", gate(API_GATES)),
        ("snapshot_gate", gate(SNAPSHOT_GATES)),
        ("sales_gate", gate(SALES_GATES)),
        ("prune_reasons", all_of([(f"hard reject: {label}", cond) for label, cond in REJECTION] + PRUNE)),
        ("protected", "manual_keep OR notes <> '' OR lower(stage) NOT IN ('', 'new', 'research', 'rejected')"),
        ("noise_reason", f"CASE WHEN protected THEN 'protected_manual_work' ELSE {first_of(NOISE)} END"),
        ("cleanup_reason", first_of(CLEANUP)),
        ("discard_reason", first_of(DISCARD)),
        ("keep_lead", "quality_status <> 'rejected' AND best_score >= 42 AND entity_type NOT IN (" + rejected + ")"),
        ("segment_now", f"coalesce({first_of(SEGMENT_OVERRIDE, 'segment')}, segment)"),
        ("lead_type_now", first_of(LEAD_TYPE)),
        ("channel", first_of(CHANNEL)),
        ("play", first_of(PLAY)),
        ("next_action", first_of(NEXT_ACTION, quoted=False)),
        ("likelihood", first_of(LIKELIHOOD)),
        ("strength", first_of(STRENGTH)),
        ("qualification_reasons", all_of(QUALIFICATION)),
        ("red_flags", all_of(RED_FLAGS)),
        ("n_flags", f"{count_of(RED_FLAGS)} + n_rejections"),
        ("tier_points", """score + (CASE WHEN n_emails > 0 THEN 22 WHEN n_forms > 0 THEN 18 WHEN n_links > 0 THEN 15 WHEN n_phones > 0 THEN 12 ELSE 0 END) + (CASE likelihood WHEN 'High' THEN 14 WHEN 'Medium' THEN 7 ELSE 0 END)
          + (CASE WHEN has(segment, hot_segment) THEN 12 WHEN has(segment, recruiting_segment) THEN 8 ELSE 0 END) + (CASE WHEN has(text, intent) THEN 12 ELSE 0 END) - 6 * n_flags"""),
        ("open_tier", "CASE WHEN tier_points >= 105 THEN 'A1 Hot' WHEN tier_points >= 88 THEN 'A2 Strong' WHEN tier_points >= 68 THEN 'B Nurture' ELSE 'C Research' END"),
        ("capped", "strength IN ('none', 'source-only') OR (strength <> 'strong' AND (bucket IN ('mql5', 'forum') OR channel = 'Source URL'))"),
        ("icp_tier", f"CASE WHEN capped AND {rank.format('open_tier')} > 1 THEN 'B Nurture' ELSE open_tier END"),
        ("hot", "icp_tier IN ('A1 Hot', 'A2 Strong')"),
        ("meeting_priority", "CASE icp_tier WHEN 'A1 Hot' THEN 'High' WHEN 'A2 Strong' THEN 'Medium-High' WHEN 'B Nurture' THEN 'Medium' ELSE 'Low' END"),
        ("qualified_contactable", "n_emails > 0 OR n_forms > 0 OR n_links > 0 OR n_direct > 0"),
        ("running", "deep_status = 'running' AND hours_running < 1"),
        ("minimum_signal", "working_ok OR strict_icp OR searchable OR specialist"),
        ("enrichable", "url <> '' AND NOT has(url, video_url) AND NOT blocked AND minimum_signal AND NOT (segment = 'Broker Site' AND lead_type <> 'recruitment') AND NOT running AND NOT has(text, platform_noise) AND n_hard_rejections = 0"),
        ("refresh_hours", f"CASE WHEN completeness < 35 THEN {contactless} WHEN outreach >= 78 OR priority = 'A' THEN {hot} ELSE {other} END"),
        ("rotation_hours", str(rotation)),
        ("due", first_of(DUE)),
        ("due_rank", "CASE due WHEN 'contactless_due' THEN 0 WHEN 'never' THEN 1 WHEN 'scheduled_due' THEN 2 WHEN 'rotation_due' THEN 3 ELSE 9 END"),
        ("platform_rank", "CASE WHEN bucket IN ('linkedin', 'instagram', 'x', 'telegram', 'discord', 'tiktok') THEN 0 WHEN bucket IN ('forum', 'recruitment') THEN 1 WHEN bucket IN ('myfxbook', 'tradingview', 'specialist') THEN 2 ELSE 3 END"),
        ("trail_target", "url <> '' AND NOT blocked AND NOT has(url, trail_noise) AND NOT has(text, trail_noise) AND (specialist OR owned_best OR (bucket IN ('linkedin', 'instagram', 'x', 'telegram', 'tiktok') AND outreach >= 76 AND has(text, identity_trading)))"),
        ("needs_trail", "trail_target AND NOT running AND hours_since_trail >= 8 AND (NOT decision_contact OR contact_confidence < 80)"),
        ("gap_target", "url <> '' AND NOT blocked AND NOT has(url, trail_noise) AND NOT has(text, trail_noise) AND NOT running AND hours_since_gap >= 2 AND ((has_best AND owned_best) OR website_only OR (NOT real_contact AND (outreach >= 78 OR priority = 'A' OR specialist) AND has(text, identity_trading)))"),
        ("gap_score", "outreach + (CASE WHEN NOT real_contact THEN 100 ELSE 0 END) + (CASE WHEN has_best AND owned_best THEN 70 ELSE 0 END) + (CASE WHEN website_only THEN 45 ELSE 0 END) + (CASE WHEN has(url, specialist_url) THEN 40 ELSE 0 END) + (CASE WHEN priority = 'A' THEN 25 ELSE 0 END) + (CASE WHEN bucket IN ('myfxbook', 'mql5', 'specialist') THEN 25 ELSE 0 END)"),
        ("needs_boost", "specialist AND (NOT has_best OR owned_email OR contact_confidence < 80) AND (best_score >= 65 OR priority = 'A')"),
        ("search_trail", "NOT actionable_contact AND contact_confidence < 80 AND NOT has(name, weak_name) AND name <> ''"),
        ("contactless", "n_emails = 0 AND n_forms = 0 AND n_links = 0 AND n_websites = 0"),
        ("suspicious", all_of(SUSPICIOUS)),
        ("n_suspicious", count_of(SUSPICIOUS)),
    ]


def literals(pattern: str) -> list[str]:
    """Texts in small letters, one of which is in whatever holds a match, once that is in small letters; none if none of three
    letters is known. Groups, classes, quantifiers and alternatives are followed; of flags, (?i) only."""
    p = pattern.removeprefix("(?i)")

    def alternatives(i: int) -> tuple[list[str], int]:
        out, known = [], True
        while True:
            ways, run = [], ""
            while i < len(p) and p[i] not in "|)":
                atom, own = "", None
                if p[i] == "(":
                    if p.startswith("(?", i) and not p.startswith("(?:", i):
                        raise ValueError(pattern)
                    own, i = alternatives(i + (3 if p.startswith("(?:", i) else 1))
                elif p[i] == "[":
                    i = re.compile(r"\[\^?\]?(?:\\.|[^\]\\\[])*\]").match(p, i).end() - 1
                elif p[i] == "\\":
                    i += 1
                    atom = "" if p[i].isalnum() else p[i]
                elif p[i] not in "^$.":
                    atom = p[i]
                edge = p[i - 1 : i + 1] == "\\b" or p[i] in "^$" and not atom
                i += 1
                mark = p[i : i + 1]
                if mark and mark in "?*+{":
                    atom, own = "", own if mark == "+" else None
                    i = p.index("}", i) + 1 if mark == "{" else i + 1
                    i += p[i : i + 1] in ("?", "+")
                if atom:
                    run += atom.lower()
                elif not edge:
                    ways += [[run], own or [""]]
                    run = ""
            best = max([*ways, [run]], key=lambda w: min(map(len, w)))
            out += best
            known = known and min(map(len, best)) >= 3
            if p[i : i + 1] != "|":
                return out if known else [], i
            i += 1

    try:
        found, end = alternatives(0)
    except (ValueError, AttributeError, IndexError):
        return []
    return list(dict.fromkeys(found)) if end == len(p) and not any(set(x) & {"'", "\\"} or not x.isascii() for x in found) else []


class Policy:
    """All derived columns for a set of vocabularies; a pattern that isn't given matches nothing."""

    def __init__(self, patterns: dict[str, str], hours: tuple[int, int, int, int] = (1, 1, 6, 2)):
        unknown = set(patterns) - set(PATTERNS)
        if unknown:
            raise ValueError(f"no such vocabulary: {sorted(unknown)}")
        self.patterns, self.steps = patterns, steps(hours)
        if any("'" in p for p in patterns.values()):
            raise ValueError("write an apostrophe in a pattern as .")
        missing = {m for _, e in self.steps for m in re.findall(r"has\(\w+, (\w+)\)", e)} - set(PATTERNS)
        assert not missing, missing

    def sql(self, condition: str, spark: bool = True) -> str:
        """A condition as SQL: Spark's, or that of an engine with regexp_matches and no escapes in its texts."""

        def found(m: re.Match) -> str:
            pattern = self.patterns.get(m[2])
            if not pattern:
                return "FALSE"
            return f"rlike({m[1]}, r'{pattern}')" if spark else f"regexp_matches({m[1]}, '{pattern}')"

        return re.sub(r"has\((\w+), (\w+)\)", found, condition)

    def facts(self, leads: DataFrame) -> DataFrame:
        """The facts that are there, without nulls, and defaults for the others."""
        have = set(leads.columns)
        of = lambda c, default, kind: F.coalesce(F.col(c).cast(kind), F.lit(default)).alias(c) if c in have else F.lit(default).cast(kind).alias(c)
        known = {*TEXTS, *NUMBERS, *FLAGS}
        return leads.select(*(c for c in leads.columns if c not in known), *(of(c, "", "string") for c in TEXTS), *(of(c, 0, "int") for c in NUMBERS), *(of(c, False, "boolean") for c in FLAGS))

    def apply(self, leads: DataFrame, wanted: list[str] | None = None) -> DataFrame:
        """The facts with the derived columns, or with those of `wanted` and what they need."""
        # Most patterns aren't found: their literal parts are sought first, in small letters that are made once.
        sought = {n: x for n, p in self.patterns.items() if p and (x := literals(p))}
        quick = lambda m: f"(({' OR '.join(f'contains(_low_{m[1]}, {x!r})' for x in sought[m[2]])}) AND {m[0]})" if m[1] in TEXTS and m[2] in sought else m[0]
        levels = [[(name, re.sub(r"has\((\w+), (\w+)\)", quick, condition)) for name, condition in level] for level in self.levels(wanted)]
        low = sorted({c for level in levels for _, e in level for c in re.findall(r"contains\(_low_(\w+),", e)})
        out = self.facts(leads).withColumns({f"_low_{c}": F.lower(c) for c in low})
        for level in levels:
            out = out.withColumns({name: F.expr(self.sql(condition)) for name, condition in level})
        return out.drop(*(f"_low_{c}" for c in low))

    def where(self, leads: DataFrame, condition: str, wanted: list[str]) -> DataFrame:
        """The rows of `apply` for which a condition on the derived columns holds. The condition stays above them: pushed down,
        it would repeat the rules of every column that it reads."""
        out = self.apply(leads, wanted).withColumn("_fence", F.monotonically_increasing_id())
        return out.filter(F.expr(condition) & (F.col("_fence") >= 0)).drop("_fence")

    def levels(self, wanted: list[str] | None = None) -> list[list[tuple[str, str]]]:
        """The steps in groups, none of which reads a column of its own group."""
        groups, own = [[]], set()
        for name, condition in self.needed(wanted):
            if own & _words(condition):
                groups.append([])
                own = set()
            groups[-1].append((name, condition))
            own.add(name)
        return groups

    def classified(self, leads: DataFrame, segments: list[tuple[str, str]], score: Column) -> DataFrame:
        """PRJ-3: segment (the first whose pattern the text holds, then the overrides of intent and source), kind of lead, score
        and priority of raw results; name, title and snippet get their fallbacks first."""
        found = self.facts(leads)
        name = F.coalesce(*(F.nullif(normalize_space(c), F.lit("")) for c in ("name", "title", "domain")), F.lit(""))
        found = found.withColumns({"name": name, "title": F.coalesce(F.nullif(normalize_space("title"), F.lit("")), name), "snippet": F.substring(normalize_space("snippet"), 1, 1000)})
        found = found.withColumn("segment", F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(label)) for label, p in segments), F.lit("Unclear")))
        out = self.apply(found, ["segment_now"]).withColumn("segment", F.col("segment_now")).drop("segment_now")
        out = self.apply(out, ["lead_type_now"]).withColumn("lead_type", F.col("lead_type_now")).drop("lead_type_now")
        # Bounds of the priorities.
        return out.withColumn("score", score).withColumn("priority", F.when(F.col("score") >= 76, "A").when(F.col("score") >= 58, "B").when(F.col("score") >= 38, "C").otherwise("D"))

    def needed(self, wanted: list[str] | None) -> list[tuple[str, str]]:
        if wanted is None:
            return self.steps
        keep, out = set(wanted), []
        for name, condition in reversed(self.steps):
            if name in keep:
                out.append((name, condition))
                keep |= _words(condition)
        return out[::-1]

    def query(self, relation: str, wanted: list[str]) -> tuple[str, str]:
        """(chain of selects, name of the last): the same columns as plain SQL over `relation`."""
        ctes, last = [], relation
        for i, level in enumerate(self.levels(wanted)):
            ctes.append(f"p{i} AS (SELECT *, {', '.join(f'{self.sql(c, False)} AS {name}' for name, c in level)} FROM {last})")
            last = f"p{i}"
        return ",\n".join(ctes), last


def _words(condition: str) -> set[str]:
    """The columns that a condition may read."""
    return set(re.findall(r"\w+", re.sub(r"'[^']*'", "", re.sub(r"has\((\w+), \w+\)", r"\1", condition))))


def blocked_query(policy: Policy, text: Column | str) -> Column:
    """FLT-16, FLT-17: search templates that are never run."""
    q = F.lower(F.col(text) if isinstance(text, str) else text)
    hit = lambda name: q.rlike(policy.patterns[name]) if policy.patterns.get(name) else F.lit(False)
    return hit("blocked_query") | hit("prop_name") | hit("query_rank") | hit("market_words") | (hit("event_words") & hit("exhibitor_words"))
