"""Policies on edge rows: a lead that passes every gate, and for each gate or rule one that it stops."""

import pytest

from tamis.functions import policies
from tamis.functions.policies import Policy

VOCABULARY = {name: f"~{name}~" for name in policies.PATTERNS}
POLICY = Policy(VOCABULARY, hours=(24, 72, 336, 720))
GOOD = {
    "url": "https://a.example/x ~specialist_url~", "platform": "Web", "name": "A", "title": "T", "domain": "a.example", "text": "a text of a lead ~target~ ~actual_signal~", "visible": "", "identity": "", "bucket": "web", "segment": "Affiliate",
    "lead_type": "partner", "priority": "A", "score": 90, "commercial_score": 90, "n_emails": 1, "n_links": 1, "country": "Spain",
}


@pytest.fixture(scope="module")
def judged(spark):
    def run(changes, *wanted):
        names = sorted({k for c in changes for k in (*GOOD, *c)})
        kind = lambda n: "string" if n in policies.TEXTS else "int" if n in policies.NUMBERS else "boolean"
        default = lambda n: "" if n in policies.TEXTS else 0 if n in policies.NUMBERS else False
        rows = [(i, *({**GOOD, **c}.get(n, default(n)) for n in names)) for i, c in enumerate(changes)]
        df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} {kind(n)}" for n in names))
        return [tuple(r[w] for w in wanted) for r in POLICY.apply(df, list(wanted)).orderBy("id").collect()]

    return run


def with_(field, *names):
    return {field: f"{GOOD.get(field, '')} " + " ".join(f"~{n}~" for n in names)}


def test_export_gates(judged):
    stops = [
        ({}, ""), ({"url": ""}, "address"), ({"platform": "YouTube"}, "not video"), ({"score": 49}, "score"), ({"score": 50}, ""), ({"priority": "D"}, "priority"), ({"segment": "Broker Site"}, "not a broker's site"),
        (with_("text", "consumer"), "not rejected"), ({"url": "https://a.example/x"}, "not rejected"), ({"n_emails": 0, "n_links": 0}, "contact"), ({"n_emails": 0, "n_links": 0, "has_best": True, "best_type": "form"}, ""),
        ({"n_emails": 0, "n_links": 0, "has_best": True, "best_type": "website"}, "contact"), (with_("url", "specialist_url", "forum_page"), "actual lead"), (with_("text", "generic_portal"), "not a portal"), ({"lead_type": "research"}, "lead type"),
        (with_("text", "export_noise"), "no export noise"), (with_("text", "education"), "education of traders"), (with_("text", "education", "finance_trader"), ""), (with_("text", "finance_media"), "no finance media"),
        ({"name": "~broker_name~"}, "no broker's name"), ({"name": "~broker_name~", "lead_type": "recruitment"}, ""), ({"url": None}, "address"),
    ]
    assert [x for (x,) in judged([c for c, _ in stops], "export_gate")] == [label for _, label in stops]


def test_working_gates(judged):
    stops = [
        ({}, ""), ({"domain": ""}, "address"), (with_("domain", "reference_site"), "no reference site"), (with_("url", "specialist_url", "video_url"), "not video"), (with_("url", "market_page", "specialist_url"), "no market page"),
        ({"domain": "www.reddit.com", "url": "https://www.reddit.com/r/x ~specialist_url~"}, "a path on profile hosts"), ({"domain": "reddit.com", "url": "https://reddit.com/U/x ~specialist_url~"}, ""), ({"domain": "x.com", "url": "https://x.com/search?q=1 ~specialist_url~"}, "a path on profile hosts"), ({"domain": "instagram.com", "url": "https://instagram.com/reel/1 ~specialist_url~"}, "a path on profile hosts"),
        ({"domain": "forexfactory.com", "url": "https://forexfactory.com/#~specialist_url~"}, "a path on profile hosts"), ({"priority": "D", "score": 44}, "priority"), ({"priority": "D", "score": 45}, ""), ({"lead_type": "research"}, "lead type"),
        ({"lead_type": "research", "qualification_status": "research_candidate"}, ""), ({"url": "https://a.example/x"}, ""), (with_("text", "consumer"), "not rejected"), (with_("text", "event_page"), "actual lead"), ({"name": "~malformed_title~"}, "proper name"),
        (with_("text", "broker_noise"), "no broker's noise"), (with_("text", "broker_noise", "insider"), ""), (with_("text", "finance_noise"), "no finance noise"), ({"text": "nothing that tells of trade"}, "trading signal"),
        ({"bucket": "mql5", "n_emails": 0, "n_links": 0}, "contact or maker"), ({"bucket": "mql5", "n_emails": 0, "n_links": 0, "n_makers": 1}, ""), ({"commercial_score": 0, "score": 34}, "score or trusted source"), ({"commercial_score": 0, "score": 34, "bucket": "~trusted_bucket~"}, ""),
    ]
    assert [x for (x,) in judged([c for c, _ in stops], "working_gate")] == [label for _, label in stops]


def test_each_rejection_reason(judged):
    cases = [
        {"snippet": "~synthetic~"}, with_("text", "infra"), {**with_("domain", "official_domain")}, {"url": "https://a.example/x"}, {"domain": "a.cfd"}, with_("visible", "payments"), with_("text", "cfd_noise"),
        {**with_("url", "video_url"), "snippet": "~synthetic~"}, with_("text", "job"), with_("url", "market_page"), with_("text", "marketing"), with_("domain", "farm_domain"), with_("text", "explainer"), with_("text", "software"), with_("text", "article"), with_("domain", "review_domain"),
        with_("domain", "bank_domain"), with_("text", "insurance"), with_("text", "news"), with_("domain", "bad_media_domain"), with_("text", "finance_role"), with_("text", "consumer"),
    ]
    found = judged(cases, "reject_reasons", "n_rejections")
    for (label, _), (reasons, n) in zip(policies.REJECTION, found):
        assert label in reasons.split("; ") and n == len(reasons.split("; ")), (label, reasons)
    assert judged([{}], "reject_reasons", "n_rejections", "n_hard_rejections") == [("", 0, 0)]
    assert judged([{"url": "x"}], "n_rejections", "n_hard_rejections") == [(1, 0)]


def test_entity_kinds_come_in_order(judged):
    one = lambda *names, **more: {**with_("text", *names), **more, "segment": more.get("segment", "Unclear"), "n_emails": more.get("n_emails", 0)}
    cases = [
        (one("job", "review"), "job_posting"), (one("review"), "review_or_seo"), (one("review", n_emails=1), "research_candidate"), (one("directory"), "directory_or_registry"), (one("prop_company", "decision_maker", "trading"), "prop_firm_company"),
        (one("decision_maker", "trading", "profile"), "decision_maker"), (one("profile", "trading"), "social_profile"), (one(segment="Fund / Asset Manager"), "capital_allocator"), (one(segment="Community"), "partner_entity"), (one("trading", "contact"), "company"),
        (one("broker_page", segment="Broker Site"), "broker_page"), (one(), "research_candidate"),
    ]
    assert [x for (x,) in judged([c for c, _ in cases], "entity")] == [e for _, e in cases]
    (row,) = judged([one("decision_maker", "trading", score=100, n_emails=1, contact_confidence=75)], "entity_score", "entity_tier", "entity_quality", "entity_signals")
    assert row == (100, "A", "qualified", "Decision maker; Contact path; Trading ICP")
    assert judged([one("job", score=0, n_emails=0)], "entity_score", "entity_quality", "commercially_rejected") == [(0, "rejected", True)]


def test_kinds_noise_and_discard(judged):
    assert judged([{}, with_("url", "forum_page"), with_("text", "event_page"), {**with_("text", "event_page"), **with_("url", "linkedin")}, {"bucket": "ecosystem", "n_emails": 0, "n_links": 0}], "actual_lead") == [(True,), (False,), (False,), (True,), (False,)]
    noise = [({}, ""), ({"notes": "called"}, "protected_manual_work"), ({"segment": "Broker Site"}, "commercial_noise_policy"), (with_("domain", "exchange_domain"), "known_currency_exchange_false_positive"), (with_("text", "press"), "generic_article_or_press_release"), (with_("text", "factory", "factory_words"), "")]
    assert [x for (x,) in judged([c for c, _ in noise], "noise_reason")] == [r for _, r in noise]
    discard = [({}, ""), ({"segment": "Broker Site"}, "blocked_commercial_noise"), (with_("text", "consumer"), "hard_rejected"), ({"qualification_status": "rejected"}, "classification_rejected"), ({"commercial_score": 27}, "commercially_rejected"), ({"commercial_score": 41}, "commercial_score_below_threshold")]
    assert [x for (x,) in judged([c for c, _ in discard], "discard_reason")] == [r for _, r in discard]


def test_tiers_and_their_caps(judged):
    base = {"segment": "x", "text": "~target~"}
    cases = [({**base, "score": 83}, "A1 Hot"), ({**base, "score": 82}, "A2 Strong"), ({**base, "score": 83, "country": ""}, "A2 Strong"), ({**base, "score": 70, "n_emails": 0, "n_links": 1, "bucket": "web"}, "B Nurture"), ({**base, "score": 100, "n_emails": 0, "n_links": 0, "n_phones": 0}, "B Nurture"), ({**base, "score": 20}, "C Research")]
    assert [x for (x,) in judged([c for c, _ in cases], "icp_tier")] == [t for _, t in cases]
    assert judged([{**base, "score": 83}], "meeting_priority", "hot", "channel", "next_action") == [("High", True, "Email", "Enviar email curto com proposta: Partner research")]


def test_due_reasons(judged):
    cases = [({"never_enriched": True}, "never"), ({"hours_since_deep": 24, "n_links": 0}, "contactless_due"), ({"hours_since_deep": 23, "n_links": 0}, ""), ({"hours_since_deep": 72, "n_phones": 1}, "scheduled_due"), ({"hours_since_deep": 71, "n_phones": 1}, ""), ({"never_enriched": True, "deep_status": "running"}, ""), ({"never_enriched": True, "segment": "Broker Site"}, "")]
    assert [x for (x,) in judged([c for c, _ in cases], "due")] == [d for _, d in cases]


def test_completeness_and_contact_scores(judged):
    none = {"n_emails": 0, "n_links": 0}
    cases = [
        ({**none, "n_forms": 1, "n_maker_links": 1, "n_links": 1, "has_best": True}, (70, 53, 58)), ({**none, "n_emails": 2, "n_phones": 1, "n_websites": 3, "n_makers": 1}, (80, 75, 85)),
        ({**none, "direct_links": "~whatsapp~ ~telegram~"}, (0, 75, 75)), ({**none, "has_best": True, "best_type": "website"}, (25, 0, 20)), ({**none, "has_best": True, "best_type": "email", "profile_best": True}, (25, 0, 20)), (none, (0, 0, 0)),
    ]
    assert judged([c for c, _ in cases], "completeness", "contact_score", "report_contact_score") == [x for _, x in cases]


def test_suspicious_rows(judged):
    icp = {"visible": "~audit_icp~", "identity": "~audit_icp~"}
    cases = [
        ({**icp}, ""), ({**icp, "placeholder_email": True, "owned_email": True, "owned_links": True}, "placeholder/generic emails; platform-owned email still present; platform-owned links still attached"),
        ({**icp, "has_best": True, "profile_best": True, "owned_best": True}, "bestContact is the source/platform profile; bestContact is platform/widget/infra-owned URL"), ({**icp, "n_emails": 0, "score": 75, "commercial_score": 0}, "high-score lead without real decision contact"),
        ({**icp, "n_emails": 0, "score": 74, "commercial_score": 0}, ""), ({}, "high-score lead without actual ICP terms in result/profile text"), ({**icp, "snippet": "~synthetic~", "name": "~weak_name~"}, "score likely inflated by synthetic search snippet; generic or weak identity/title"),
        ({"bucket": "x", "visible": "found by ~audit_icp~ search", "query": "~audit_icp~ search"}, "social profile appears query-driven, not profile-driven"), ({"bucket": "x", "visible": "~audit_icp~ ~audit_icp~", "query": "~audit_icp~"}, ""),
        ({**icp, "bucket": "mql5"}, "specialist/platform lead has weak contact score"), ({**icp, "bucket": "mql5", "n_phones": 1}, ""), ({**icp, "n_emails": 0, "n_websites": 1, "commercial_score": 10}, "website-only route, not execution-ready"),
    ]
    assert [x for (x,) in judged([c for c, _ in cases], "suspicious")] == [x for _, x in cases]


def test_cleanup_and_prune_reasons(judged):
    texts = [("On TradingView", "tradingview_not_target_lead"), ("GOOGLE PAY", "payments_platform_noise"), ("nba standings", "sports_reference_noise"), ("latex templates", "document_template_noise"), ("a fair with a booth list", "event_exhibitor_list_not_target"), ("the forex expo on scribd.com", "event_exhibitor_document_not_target"), ("a fair", "")]
    assert [x for (x,) in judged([{"text": t} for t, _ in texts], "cleanup_reason")] == [r for _, r in texts]
    assert judged([{"text": "", "bucket": "tradingview"}], "cleanup_reason") == [("tradingview_not_target_lead",)]
    (row,) = judged([{**with_("text", "software"), "visible": "~strict_icp~", "owned_email": True}], "prune_reasons")
    assert row == ("hard reject: non-trading business software page; placeholder/platform email contamination",)


def test_vocabularies_are_checked():
    with pytest.raises(ValueError):
        Policy({"no such": "x"})
    with pytest.raises(ValueError):
        Policy({"job": "it's"})


def test_patterns_are_sought_by_their_literals_first(spark):
    import re

    from tamis.functions.policies import Policy, literals

    given = {r"(?i)\b(Review|top ten)\b": ["review", "top ten"], r"^(.*\.)?a\.example$": ["a.example"], r"(?i)\bfx\b": [], r"abc|d": [], r"abcd?e{2}fgh+": ["abc"], r"(?:one|two)+[a|b]x": ["one", "two"], r"(?u)abc": [], r"a.c\d": [], r"\)posts?": [")post"], r"(abc)?": []}
    assert {p: literals(p) for p in given} == given
    for p in given:
        for text in ("Top TEN", "a REVIEW", "x.a.example", "abce efghh", "abceefgh", "twoax", "oneonebx", ")Post )post"):
            assert not literals(p) or not re.search(p, text) or any(x in text.lower() for x in literals(p)), (p, text)
    policy, leads = Policy({"strong_trading": r"(?i)\b(forex|gold)\b"}), spark.createDataFrame([(1, "FOREX İ"), (2, "forexx"), (3, "Gold"), (4, None), (5, "")], "id int, text string")
    found = policy.apply(leads, ["strong_trading"])
    assert {r["id"] for r in found.filter("strong_trading").collect()} == {1, 3} and not [c for c in found.columns if c.startswith("_low")]
    assert "contains(" in found.select("strong_trading")._jdf.queryExecution().optimizedPlan().toString().lower()
