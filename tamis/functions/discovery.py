"""Candidates and follow-up searches: query variants, relevance, identity of hits, waves of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import _col, fold, identity_tokens, normalize_space
from tamis.functions.urls import domain_of, path_parts, safe_url
from tamis.operators.core import first_per


def relaxed_query(query: Column | str) -> Column:
    """URL-12: a query without quotes, site limits, exclusions and operators."""
    t = F.regexp_replace(F.coalesce(_col(query), F.lit("")), r"(?i)(?:^|\s)-?(?:site|inurl|intitle):\S+", " ")
    t = F.regexp_replace(t, r"(?:^|\s)-\S+", " ")
    return normalize_space(F.regexp_replace(t, r"[\"()|]|\bOR\b|\bAND\b", " "))


def query_variants(query: Column | str, most: int = 4) -> Column:
    """URL-12: rewritten forms of a query for a second wave, distinct, the query itself left out."""
    q, r = normalize_space(query), relaxed_query(query)
    head = F.array_join(F.slice(F.split(r, " "), 1, 5), " ")
    return F.slice(F.filter(F.array_distinct(F.array(r, F.concat(r, F.lit(" contact")), head, F.concat(head, F.lit(" profile")))), lambda v: (v != q) & (v != "")), 1, most)


def contact_queries(name: Column | str, templates: list[str]) -> Column:
    """PRJ-14: a name in each template, whose {name} is filled once."""
    n = normalize_space(name)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array(*(F.concat(F.lit(t.partition("{name}")[0]), n, F.lit(t.partition("{name}")[2])) for t in templates)))


def matches_identity(text: Column | str, aliases: Column, tokens: Column, context: Column | None = None) -> Column:
    """FLT-22: an alias (folded, of four letters or more) in the folded text, or two of the tokens; a single token does where
    the context holds."""
    t = fold(text)
    hits = F.size(F.filter(tokens, lambda w: t.contains(w)))
    out = F.exists(aliases, lambda a: (F.length(a) >= 4) & t.contains(a)) | (hits >= 2)
    return out | ((hits >= 1) & context) if context is not None else out


def aliases_of(name: Column | str, generic: list[str] = ()) -> tuple[Column, Column]:
    """PRJ-13: (aliases, tokens) of a name: the folded whole and its first two words, and the tokens that aren't generic."""
    words = identity_tokens(name, generic)
    return F.array_distinct(F.array(fold(name), F.array_join(F.slice(words, 1, 2), ""))), words


def candidate_path(url: Column | str, rules: DataFrame) -> Column:
    """FLT-21: condition for a join with `rules` (host, first array, deny array, least): the address's host is the rule's or
    below it, its path has at least `least` segments, and its first one is allowed (any, if none is given) and not denied."""
    d, p = domain_of(url), path_parts(url)
    first = F.lower(F.coalesce(F.get(p, F.lit(0)), F.lit("")))
    own = F.array_contains(F.transform(F.sequence(F.lit(1), F.size(F.split(d, r"\."))), lambda i: F.array_join(F.slice(F.split(d, r"\."), i, 20), ".")), rules["host"])
    return own & (F.size(p) >= rules["least"]) & ((F.size(rules["first"]) == 0) | F.array_contains(rules["first"], first)) & ~F.array_contains(rules["deny"], first)


def waves(results: DataFrame, *, by: str, url: str, wave: str, ord_: str, limit: int) -> DataFrame:
    """SRC-4, SRC-5: results of several engines and waves, the first of each address in wave and order, and of each query the
    first `limit`; a later wave fills what an earlier one left open."""
    keyed = results.withColumn("_url", safe_url(url)).filter("_url is not null")
    distinct = first_per(keyed, F.struct(by, "_url"), [F.asc(wave), F.asc(ord_)])
    place = F.row_number().over(_window(by, wave, ord_))
    return distinct.withColumn("place", place).filter(F.col("place") <= limit).drop("_url")


def _window(by: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(by).orderBy(*map(F.asc, order))


def allowed_pages(pages: DataFrame, url: str, denied: DataFrame) -> DataFrame:
    """SRC-8: pages whose host isn't, and isn't below, a denied one (`host`)."""
    from tamis.operators.core import suffix_join

    return suffix_join(pages.withColumn("_domain", domain_of(url)), "_domain", denied, "left_anti").drop("_domain")


def video_info(html: Column | str) -> Column:
    """EXT-7: struct(channel, subscribers, description) from the data that video pages carry; null where there is none."""
    h = F.coalesce(_col(html), F.lit(""))
    text = lambda pattern: F.nullif(F.regexp_extract(h, pattern, 1), F.lit(""))
    return F.struct(text(r'"ownerChannelName":"([^"]*)"').alias("channel"), text(r'"subscriberCountText":\{[^}]*?"simpleText":"([^"]*)"').alias("subscribers"), text(r'"shortDescription":"((?:[^"\\]|\\.)*)"').alias("description"))
