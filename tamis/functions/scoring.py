"""Labels, capped additive scores and tiers over rules that are data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import contains_word, count_matches, half_up, includes_any


def first_label(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """CLS-1, FLT-13: the label of the first rule that holds."""
    out = None
    for label, holds in rules:
        out = F.when(holds, label) if out is None else out.when(holds, label)
    return out.otherwise(F.lit(default))


def all_labels(rules: list[tuple[str, Column]], most: int | None = None) -> Column:
    """CLS-4, CLS-5, FLT-11: the labels of all rules that hold, in the rules' order, each once."""
    found = F.array_distinct(F.array_compact(F.array(*(F.when(holds, label) for label, holds in rules))))
    return F.slice(found, 1, most) if most else found


def label_rules(text: Column | str, vocabulary: dict[str, list[str]]) -> list[tuple[str, Column]]:
    return [(label, includes_any(text, terms)) for label, terms in vocabulary.items()]


def word_rules(text: Column | str, patterns: dict[str, str]) -> list[tuple[str, Column]]:
    return [(label, contains_word(text, pattern)) for label, pattern in patterns.items()]


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def term_score(text: Column | str, base: int, lists: list[tuple[list[str], int, int]], bonuses: list[tuple[Column, int]] = ()) -> Column:
    """CLS-6: base, plus each list's count times its weight up to its cap, plus bonuses (negative ones too), in 0..100."""
    parts = [F.lit(base), *(F.least(F.lit(cap), count_matches(text, terms) * weight) for terms, weight, cap in lists), *(F.when(c, v).otherwise(0) for c, v in bonuses)]
    return clamp(half_up(reduce(lambda a, b: a + b, parts))).cast("int")


def graded(score: Column, steps: list[tuple[int, str]], lowest: str) -> Column:
    """CLS-7: the label of the first step that the score reaches."""
    return first_label([(label, score >= at) for at, label in steps], lowest)


# Thresholds of the three tier scales.
PRIORITY = [(76, "A"), (58, "B"), (38, "C")]
COMMERCIAL = [(82, "A"), (66, "B"), (48, "C")]
ICP = [(105, "A1 Hot"), (88, "A2 Strong"), (68, "B Nurture")]
ICP_ORDER = ["C Research", "B Nurture", "A2 Strong", "A1 Hot"]


def priority(score: Column) -> Column:
    return graded(score, PRIORITY, "D")


def commercial_tier(score: Column) -> Column:
    return graded(score, COMMERCIAL, "D")


def icp_tier(total: Column) -> Column:
    return graded(total, ICP, "C Research")


def cap_tier(tier: Column, most: Column) -> Column:
    """The lower of two tiers; an unknown one stays."""
    order = F.array(*map(F.lit, ICP_ORDER))
    rank = F.least(F.array_position(order, tier), F.array_position(order, most)).cast("int")
    return F.when(rank > 0, F.get(order, rank - 1)).otherwise(tier)


def commercial_score(entity: Column, score: Column, bonuses: list[tuple[Column, int]]) -> Column:
    """CLS-9: by type of entity, 0.18 of the score up to 18, bonuses; in 0..100."""
    # What each type starts with.
    base = {
        "prop_firm_company": 58, "decision_maker": 64, "partner_entity": 56, "social_profile": 48, "capital_allocator": 54, "company": 50,
        "research_candidate": 28, "review_or_seo": 5, "job_posting": 4, "directory_or_registry": 10, "broker_page": 8,
    }
    start = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in base.items() for x in kv)), entity), F.lit(20))
    total = start + F.least(F.lit(18.0), F.coalesce(score, F.lit(0)) * 0.18)
    for c, v in bonuses:
        total = total + F.when(c, v).otherwise(0)
    return clamp(half_up(total)).cast("int")


# Source buckets in order of precedence, and the order in which they take turns.
BUCKET_RULES = [
    ("mql5", "mql5"), ("linkedin", "linkedin"), ("instagram", "instagram"), ("x", r"x\.com|twitter|x/twitter"), ("telegram", r"telegram|t\.me"),
    ("discord", "discord|disboard"), ("tiktok", "tiktok"), ("facebook_threads", "facebook|threads"), ("myfxbook", "myfxbook"), ("tradingview", "tradingview"),
    ("specialist", "fxblue|zulutrade|darwinex|signalstart|collective2"), ("forum", "reddit|forum|forexfactory|babypips|earnforex|forexpeacearmy|trade2win|elitetrader"),
    ("ecosystem", "expo|summit|event|speaker|sponsor|exhibitor|opencorporates|registry|regulatory|adviserinfo|fca|cvm|cnmv|cmfchile|superfinanciera|company-information"),
    ("recruitment", "business development|partnership manager|affiliate manager|country manager|regional manager|retention manager|sales manager|broker talent|recruitment"),
]
BUCKET_ORDER = ["linkedin", "instagram", "x", "telegram", "discord", "tiktok", "facebook_threads", "myfxbook", "tradingview", "specialist", "forum", "ecosystem", "recruitment", "web", "mql5"]


def source_bucket(text: Column) -> Column:
    """CLS-12."""
    t = F.lower(text)
    return first_label([(label, t.rlike(pattern)) for label, pattern in BUCKET_RULES], "web")


def source_rank(bucket: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, BUCKET_ORDER)), bucket)
    return F.when(at > 0, at - 1).otherwise(len(BUCKET_ORDER)).cast("int")


def outbound(language: Column, templates: dict[str, str], **fields: Column) -> Column:
    """PRJ-9: the language's template (else English) with {name} filled in."""
    table = F.create_map(*(F.lit(x) for kv in templates.items() for x in kv))
    text = F.coalesce(F.element_at(table, language), F.lit(templates["en"]))
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text
