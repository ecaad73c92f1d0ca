"""Queries of the record operators, each with SQL for the same rows. Keys name the operator they show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import contacts as C
from tamis.functions import qualify as Q
from tamis.functions import scoring as S
from tamis.functions import text as T
from tamis.functions import urls as U
from tamis.operators import core as O
from tamis.operators import reports as R
from tamis.operators.terms import find_terms
from tamis.plans.demo import LEADS, domain_sql, leads, safe_url_sql, table, url_part
from tamis.sources import pages as P
from tamis.sources.sinks import csv_lines, snapshot
from tamis.sources.tables import api_results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def by_score() -> list:
    return [F.desc("score"), F.desc("last_seen"), F.asc("ord")]


def best() -> Column:
    return F.when(F.col("commercial_score") != 0, F.col("commercial_score")).otherwise(F.col("score"))


BEST_SQL = "CASE WHEN commercial_score <> 0 THEN commercial_score ELSE score END"

# --- filters ----------------------------------------------------------------------------------------------------------


@query("flt_free_text", f"WITH {LEADS} SELECT id, name FROM leads WHERE contains(lower(concat_ws(' ', name, country, segment, bucket)), 'nation_7 build')")
def _(spark, d):
    return O.search(leads(spark, d), "NATION_7 build", ["name", "country", "segment", "bucket"]).select("id", "name")


@query("flt_facets", f"WITH {LEADS} SELECT id FROM leads WHERE (CASE WHEN score >= 76 THEN 'A' WHEN score >= 58 THEN 'B' WHEN score >= 38 THEN 'C' ELSE 'D' END) = 'A' AND coalesce(nullif(stage, ''), 'new') = 'new' AND segment = 'BUILDING'")
def _(spark, d):
    return leads(spark, d).filter((S.priority(F.col("score")) == "A") & (T.falsy("stage", F.lit("new")) == "new") & (F.col("segment") == "BUILDING")).select("id")


@query("flt_web_is_no_other", f"WITH {LEADS} SELECT id FROM leads WHERE NOT (bucket IN ('linkedin', 'instagram', 'x', 'telegram', 'discord', 'tiktok', 'mql5'))")
def _(spark, d):
    others = [F.col("bucket") == b for b in ("linkedin", "instagram", "x", "telegram", "discord", "tiktok", "mql5")]
    met = others[0]
    for c in others[1:]:
        met = met | c
    return leads(spark, d).filter(~met).select("id")


@query("flt_export_gates", f"WITH {LEADS} SELECT id, name, score FROM leads WHERE score >= 50 AND segment <> 'MACHINERY' AND bucket NOT IN ('forum', 'web') AND value > 50000 AND intent <> '5-LOW'")
def _(spark, d):
    gates = [("low score", F.col("score") < 50), ("segment", F.col("segment") == "MACHINERY"), ("bucket", F.col("bucket").isin("forum", "web")), ("value", F.col("value") <= 50000), ("intent", F.col("intent") == "5-LOW")]
    return O.with_first_reason(leads(spark, d), gates).filter("reason is null").select("id", "name", "score")


@query(
    "flt_all_reasons",
    f"WITH {LEADS} SELECT id, concat_ws('; ', CASE WHEN score < 50 THEN 'low score' END, CASE WHEN segment = 'MACHINERY' THEN 'segment' END, CASE WHEN bucket IN ('forum', 'web') THEN 'bucket' END, CASE WHEN stage = '' THEN 'no stage' END) AS reasons FROM leads",
)
def _(spark, d):
    rules = [("low score", F.col("score") < 50), ("segment", F.col("segment") == "MACHINERY"), ("bucket", F.col("bucket").isin("forum", "web")), ("no stage", F.col("stage") == "")]
    return O.with_reasons(leads(spark, d), rules).select("id", F.concat_ws("; ", "reasons").alias("reasons"))


@query("flt_first_reason", f"WITH {LEADS} SELECT id, CASE WHEN value < 20000 THEN 'small' WHEN score < 20 THEN 'weak' WHEN bucket = 'mql5' THEN 'platform' END AS reason FROM leads")
def _(spark, d):
    return O.with_first_reason(leads(spark, d), [("small", F.col("value") < 20000), ("weak", F.col("score") < 20), ("platform", F.col("bucket") == "mql5")]).select("id", "reason")


@query("flt_protected_prune", f"WITH {LEADS}, c AS (SELECT id, score < 30 AND stage <> 'contacted' AS gone FROM leads) SELECT CASE WHEN gone THEN 'archived' ELSE 'kept' END AS part, count(*) AS n FROM c GROUP BY 1")
def _(spark, d):
    kept, gone = O.split(leads(spark, d), (F.col("score") < 30) & (F.col("stage") != "contacted"))
    return kept.select(F.lit("kept").alias("part")).unionAll(gone.select(F.lit("archived").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))


@query("flt_time_window", f"WITH {LEADS} SELECT id FROM leads WHERE last_seen >= TIMESTAMP '1997-06-01' - INTERVAL 720 HOUR AND last_seen < TIMESTAMP '1997-06-01'")
def _(spark, d):
    now = F.lit("1997-06-01").cast("timestamp")
    return leads(spark, d).filter((F.col("last_seen") >= now - F.expr("INTERVAL 720 HOURS")) & (F.col("last_seen") < now)).select("id")


@query("flt_term_audit", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 30")
def _(spark, d):
    return O.search(table(spark, d, "documents"), "license", ["text"]).orderBy("doc_id").limit(30).select("doc_id")


@query("flt_site_constraint", f"SELECT page_id FROM pages WHERE {domain_sql('url')} LIKE '%.example.org' OR {domain_sql('url')} = 'example.org'")
def _(spark, d):
    return table(spark, d, "pages").filter(U.matches_site("url", U.site_constraint(F.lit("best pages site:example.org")))).select("page_id")


@query("flt_multi_gate_counts", f"WITH {LEADS} SELECT CAST(count(*) FILTER (WHERE score >= 45) AS BIGINT) AS ui, CAST(count(*) FILTER (WHERE score >= 76 OR commercial_score >= 82) AS BIGINT) AS hot, CAST(count(*) FILTER (WHERE stage = '') AS BIGINT) AS no_stage, CAST(count(*) FILTER (WHERE value > 200000) AS BIGINT) AS large FROM leads")
def _(spark, d):
    return leads(spark, d).agg(F.count_if(F.col("score") >= 45).alias("ui"), F.count_if((F.col("score") >= 76) | (F.col("commercial_score") >= 82)).alias("hot"), F.count_if(F.col("stage") == "").alias("no_stage"), F.count_if(F.col("value") > 200000).alias("large"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("join_semi_allow_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    allowed = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey")


@query("join_anti_deny_list", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 0"), "doc_id", "left_anti").select("doc_id")


@query("join_domain_suffix", f"WITH p AS (SELECT page_id, {domain_sql('url')} AS domain FROM pages), h AS (SELECT regexp_extract(domain, '([^.]+\\.[^.]+)$', 1) AS host FROM p GROUP BY 1 HAVING count(DISTINCT domain) > 1) SELECT DISTINCT page_id FROM p, h WHERE domain = host OR ends_with(domain, '.' || host)")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", U.domain_of("url").alias("domain"))
    # Hosts that pages of several domains are below.
    hosts = p.groupBy(F.regexp_extract("domain", r"([^.]+\.[^.]+)$", 1).alias("host")).agg(F.countDistinct("domain").alias("n")).filter("n > 1")
    return O.suffix_join(p, "domain", hosts).select("page_id")


@query("join_contains_terms", "SELECT p_partkey, t.term FROM part JOIN (VALUES ('steel'), ('brass'), ('promo')) t(term) ON contains(lower(p_type), t.term)")
def _(spark, d):
    terms = spark.createDataFrame([("steel",), ("brass",), ("promo",)], "term string")
    return find_terms(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", terms).select("p_partkey", "term")


@query("join_template_regions", "WITH t AS (SELECT n_nationkey AS i, n_name AS family_text FROM nation), r AS (SELECT list(r_name ORDER BY r_regionkey) AS names FROM region) SELECT CAST(i AS INT) AS idx, family_text || ' ' || names[CAST(i % len(names) AS INT) + 1] AS query FROM t, r")
def _(spark, d):
    regions = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    plan = table(spark, d, "nation").select(F.lit("one").alias("family"), F.col("n_nationkey").alias("ord"), F.concat("n_name", F.lit(" {region}")).alias("text"))
    return O.interleave(plan, "family", "text", F.lit(0), regions).select(F.col("idx").cast("int").alias("idx"), "query")


@query("join_rank_lookup", f"WITH {LEADS} SELECT id, CASE bucket WHEN 'linkedin' THEN 0 WHEN 'instagram' THEN 1 WHEN 'x' THEN 2 WHEN 'telegram' THEN 3 WHEN 'discord' THEN 4 WHEN 'tiktok' THEN 5 WHEN 'facebook_threads' THEN 6 WHEN 'myfxbook' THEN 7 WHEN 'tradingview' THEN 8 WHEN 'specialist' THEN 9 WHEN 'forum' THEN 10 WHEN 'ecosystem' THEN 11 WHEN 'recruitment' THEN 12 WHEN 'web' THEN 13 ELSE 14 END AS source_rank FROM leads")
def _(spark, d):
    return leads(spark, d).select("id", S.source_rank(F.col("bucket")).alias("source_rank"))


@query("join_restore_overlay", f"WITH {LEADS} SELECT id, CASE WHEN id % 10 = 0 THEN 'restored' ELSE stage END AS stage FROM leads")
def _(spark, d):
    now = leads(spark, d).select("id", "stage")
    return O.overlay(now, now.filter("id % 10 = 0").withColumn("stage", F.lit("restored")), "id").select("id", "stage")


# --- aggregation ------------------------------------------------------------------------------------------------------


@query("agg_count_by", f"WITH {LEADS} SELECT coalesce(nullif(stage, ''), 'unknown') AS key, count(*) AS n FROM leads GROUP BY 1")
def _(spark, d):
    return O.count_by(leads(spark, d), F.col("stage"))


@query("agg_facets", f"WITH {LEADS} SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM leads GROUP BY 2 UNION ALL SELECT 'country', country, count(*) FROM leads GROUP BY 2 UNION ALL SELECT 'stage', coalesce(nullif(stage, ''), 'Unknown'), count(*) FROM leads GROUP BY 2")
def _(spark, d):
    return O.facets(leads(spark, d), {"segment": "Unclear", "country": "Unknown", "stage": "Unknown"})


@query("agg_overlapping_categories", f"WITH {LEADS} SELECT 'hot' AS category, count(*) FILTER (WHERE score >= 76) AS n FROM leads UNION ALL SELECT 'large', count(*) FILTER (WHERE value > 200000) FROM leads UNION ALL SELECT 'social', count(*) FILTER (WHERE bucket IN ('linkedin', 'instagram', 'x')) FROM leads")
def _(spark, d):
    return O.category_counts(leads(spark, d), {"hot": F.col("score") >= 76, "large": F.col("value") > 200000, "social": F.col("bucket").isin("linkedin", "instagram", "x")})


@query("agg_tiers", f"WITH {LEADS}, t AS (SELECT CASE WHEN score + 20 >= 105 THEN 'A1 Hot' WHEN score + 20 >= 88 THEN 'A2 Strong' WHEN score + 20 >= 68 THEN 'B Nurture' ELSE 'C Research' END AS tier, bucket FROM leads) SELECT CASE WHEN bucket IN ('forum', 'mql5') AND tier LIKE 'A%' THEN 'B Nurture' ELSE tier END AS tier, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    tier = S.icp_tier(F.col("score") + 20)
    capped = F.when(F.col("bucket").isin("forum", "mql5"), S.cap_tier(tier, F.lit("B Nurture"))).otherwise(tier)
    return leads(spark, d).groupBy(capped.alias("tier")).agg(F.count("*").alias("n"))


@query("agg_source_stats", "SELECT event_type AS source, user_id % 4 AS worker, count(*) AS searches, CAST(count(*) FILTER (WHERE value >= 50) AS BIGINT) AS qualified, CASE WHEN count(*) > 0 THEN floor(1000.0 * count(*) FILTER (WHERE value >= 50) / count(*) + 0.5) / 10 ELSE 0 END AS percent FROM events GROUP BY ROLLUP (user_id % 4, event_type)")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("worker"), F.col("event_type").alias("source"), "value")
    out = e.rollup("worker", "source").agg(F.count("*").alias("searches"), F.count_if(F.col("value") >= 50).alias("qualified"))
    return out.select("source", "worker", "searches", "qualified", O.percent(F.col("qualified"), F.col("searches")).alias("percent"))


@query("agg_reason_histogram", f"WITH {LEADS}, r AS (SELECT unnest(list_filter([CASE WHEN score < 50 THEN 'low score' END, CASE WHEN stage = '' THEN 'no stage' END, CASE WHEN value < 50000 THEN 'small' END], lambda x: x IS NOT NULL)) AS reason FROM leads) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    rules = [("low score", F.col("score") < 50), ("no stage", F.col("stage") == ""), ("small", F.col("value") < 50000)]
    return O.with_reasons(leads(spark, d), rules).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("agg_duplicate_stats", "SELECT count(text) AS total, count(DISTINCT text) AS distinct_keys, count(text) - count(DISTINCT text) AS duplicates FROM documents")
def _(spark, d):
    return O.duplicate_stats(table(spark, d, "documents"), F.col("text"))


@query("agg_duplicate_groups", f"WITH {LEADS}, r AS (SELECT cust, id, row_number() OVER (PARTITION BY cust ORDER BY id) AS rn, count(*) OVER (PARTITION BY cust) AS n FROM leads) SELECT cust, max(n) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS sample FROM r WHERE n > 1 AND rn <= 5 GROUP BY cust")
def _(spark, d):
    return O.duplicate_groups(leads(spark, d), "cust", "id", "id").select("cust", "n", F.concat_ws(",", F.col("sample").cast("array<string>")).alias("sample"))


@query("agg_best_per_company", f"WITH {LEADS} SELECT cust, id, score FROM leads QUALIFY row_number() OVER (PARTITION BY cust ORDER BY score DESC, ord) = 1")
def _(spark, d):
    return O.first_per(leads(spark, d), "cust", [F.desc("score"), F.asc("ord")]).select("cust", "id", "score")


@query("agg_merge_entities", f"WITH {LEADS}, b AS (SELECT cust, intent, country FROM leads QUALIFY row_number() OVER (PARTITION BY cust ORDER BY score DESC, ord) = 1), m AS (SELECT cust, max(commercial_score) AS commercial_score, min(last_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS n_rows, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS buckets FROM leads GROUP BY cust) SELECT m.cust, b.intent, b.country, m.commercial_score, m.first_seen, m.last_seen, m.n_rows, m.buckets FROM m JOIN b USING (cust)")
def _(spark, d):
    rows = leads(spark, d).withColumns({"buckets": F.array("bucket"), "first_seen": F.col("last_seen")})
    out = O.merge_entities(rows, "cust", [F.col("ord")], best=["intent", "country"], by="score", union=["buckets"], most=["commercial_score"], first_seen="first_seen", last_seen="last_seen")
    return out.withColumn("buckets", F.concat_ws(",", "buckets"))


@query("agg_queue_stats", "SELECT event_type, count(*) AS eligible, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR) AS BIGINT) AS last_day, CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 HOUR) AS BIGINT) AS last_hour, max(ts) AS newest FROM events GROUP BY 1")
def _(spark, d):
    now = F.lit("2024-01-30").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("eligible"), F.count_if(ts >= now - F.expr("INTERVAL 24 HOURS")).alias("last_day"), F.count_if(ts >= now - F.expr("INTERVAL 1 HOUR")).alias("last_hour"), F.max(ts).alias("newest"))


@query("agg_funnel", f"WITH {LEADS} SELECT bucket, count(*) AS raw, CAST(count(*) FILTER (WHERE score >= 50) AS BIGINT) AS qualified, CAST(count(*) FILTER (WHERE score >= 50 AND stage = 'contacted') AS BIGINT) AS ready, floor(1000.0 * count(*) FILTER (WHERE score >= 50 AND stage = 'contacted') / count(*) + 0.5) / 1000 AS ready_ratio FROM leads GROUP BY bucket")
def _(spark, d):
    q = F.col("score") >= 50
    out = leads(spark, d).groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(q).alias("qualified"), F.count_if(q & (F.col("stage") == "contacted")).alias("ready"))
    return out.withColumn("ready_ratio", O.ratio(F.col("ready"), F.col("raw")))


@query("agg_top_entries", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("agg_newest_row", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("agg_stage_funnel_in_order", f"WITH {LEADS}, s(stage, pos) AS (VALUES ('new', 0), ('contacted', 1), ('replied', 2), ('meeting', 3)), c AS (SELECT coalesce(nullif(stage, ''), 'new') AS stage, count(*) AS n FROM leads GROUP BY 1) SELECT s.pos, s.stage, c.n FROM s JOIN c USING (stage)")
def _(spark, d):
    stages = spark.createDataFrame([("new", 0), ("contacted", 1), ("replied", 2), ("meeting", 3)], "stage string, pos int")
    counts = O.count_by(leads(spark, d), F.col("stage"), "new", "stage")
    return stages.join(counts, "stage").select("pos", "stage", "n")


# --- windows, sorts, selection ----------------------------------------------------------------------------------------


@query("win_round_robin", f"WITH {LEADS}, r AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, ord) - 1 AS a, count(*) OVER (PARTITION BY bucket) AS n FROM leads), t AS (SELECT id, bucket, (a - 3 + n) % n AS turn FROM r) SELECT id, bucket, turn FROM t ORDER BY turn, list_position({'[' + ', '.join(repr(b) for b in S.BUCKET_ORDER) + ']'}, bucket) LIMIT 200")
def _(spark, d):
    return O.round_robin(leads(spark, d), "bucket", S.source_rank(F.col("bucket")), [F.desc("score"), F.asc("ord")], offset=3, limit=200).select("id", "bucket", "turn")


@query("win_quota", f"WITH {LEADS}, n AS (SELECT count(*) FILTER (WHERE segment = 'MACHINERY') AS c, count(*) FILTER (WHERE segment <> 'MACHINERY') AS r FROM leads), k AS (SELECT id, segment, sum(CASE WHEN segment = 'MACHINERY' THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, last_seen DESC, ord ROWS UNBOUNDED PRECEDING) AS used FROM leads) SELECT id FROM k, n WHERE segment <> 'MACHINERY' OR used <= least(c, greatest(15, CAST(ceil(r * 0.1 / 0.9) AS BIGINT)))")
def _(spark, d):
    return O.limit_share(leads(spark, d), F.col("segment") == "MACHINERY", by_score(), 0.1, 15).select("id")


@query("win_diversify", "WITH r AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) SELECT p_partkey, p_brand FROM r ORDER BY CASE WHEN rn > 10 THEN 1 ELSE 0 END, CASE WHEN rn <= 10 THEN rn END, CASE WHEN rn <= 10 THEN p_brand END, p_size DESC, p_partkey LIMIT 30")
def _(spark, d):
    return O.diversify(table(spark, d, "part"), "p_brand", F.col("p_brand"), [F.desc("p_size"), F.asc("p_partkey")], 30).select("p_partkey", "p_brand")


@query("win_first_wins", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def _(spark, d):
    return O.first_per(table(spark, d, "documents").withColumn("k", F.sha2(F.lower("text"), 256)), "k", [F.asc("doc_id")]).select("doc_id")


@query("win_history_cap", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def _(spark, d):
    return O.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("win_prune_limit", f"WITH {LEADS}, p AS (SELECT id, ord, score < 20 AS doomed, sum(CASE WHEN score < 20 THEN 1 ELSE 0 END) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM leads) SELECT id FROM p WHERE NOT doomed OR k > 100")
def _(spark, d):
    return O.prune(leads(spark, d).select("id", "ord", "score"), F.col("score") < 20, [F.asc("ord")], 100).select("id")


@query("srt_list_page", f"WITH {LEADS} SELECT id, score FROM leads ORDER BY score DESC, last_seen DESC, ord LIMIT 180 OFFSET 360")
def _(spark, d):
    return O.page(leads(spark, d), by_score(), 180, 360).select("id", "score")


@query("srt_falsy_score", f"WITH {LEADS} SELECT id, {BEST_SQL} AS best FROM leads ORDER BY best DESC, last_seen DESC, ord LIMIT 100")
def _(spark, d):
    return leads(spark, d).withColumn("best", best()).orderBy(F.desc("best"), F.desc("last_seen"), "ord").limit(100).select("id", "best")


@query("srt_export_composite", f"WITH {LEADS} SELECT id FROM leads ORDER BY commercial_score + CASE WHEN stage = 'contacted' THEN 35 ELSE 0 END + CASE WHEN value > 100000 THEN 10 ELSE 0 END DESC, list_position({'[' + ', '.join(repr(b) for b in S.BUCKET_ORDER) + ']'}, bucket), score DESC, last_seen DESC, ord LIMIT 250")
def _(spark, d):
    contact = F.col("commercial_score") + F.when(F.col("stage") == "contacted", 35).otherwise(0) + F.when(F.col("value") > 100000, 10).otherwise(0)
    return leads(spark, d).orderBy(contact.desc(), S.source_rank(F.col("bucket")), *by_score()).limit(250).select("id")


@query("srt_queue_head", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) = 1")
def _(spark, d):
    return O.first_per(table(spark, d, "events"), "user_id", [F.desc("value"), F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query("srt_due_work", "WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_type <> 'view') AS last, avg(value) AS v, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN last IS NULL THEN 'never' WHEN (epoch_us(TIMESTAMP '2024-02-02') - epoch_us(last)) / 3.6e9 >= CASE WHEN n < 35 THEN 24 WHEN v > 60 THEN 72 ELSE 336 END THEN CASE WHEN v < 40 THEN 'contactless' ELSE 'scheduled' END END AS due FROM u")
def _(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "view", F.col("ts"))).alias("last"), F.avg("value").alias("v"), F.count("*").alias("n"))
    return u.select("user_id", O.due_reason(F.lit("2024-02-02").cast("timestamp"), F.col("last").cast("timestamp"), F.col("v") < 40, F.col("v") > 60, F.col("n")).alias("due"))


# --- sets, deduplication, upsert --------------------------------------------------------------------------------------


@query("set_union_all_by_name", "SELECT c_custkey AS key, c_name AS name, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("set_except_intersect", "SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers only', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def _(spark, d):
    c, s = table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey")
    both, only = c.intersect(s), c.subtract(s)
    return both.agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionAll(only.agg(F.lit("customers only").alias("part"), F.count("*").alias("n")))


@query("ded_run_level", f"SELECT page_id FROM pages QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace({safe_url_sql('url')}, '/$', '')) ORDER BY page_id) = 1")
def _(spark, d):
    return O.first_per(table(spark, d, "pages").withColumn("k", F.lower(F.regexp_replace(U.safe_url("url"), "/$", ""))), "k", [F.asc("page_id")]).select("page_id")


@query("ded_profile_key", f"SELECT 'url:' || {domain_sql('url')} || CASE WHEN trim({url_part('url', 4)}, '/') = '' THEN '' ELSE '/' || lower(trim({url_part('url', 4)}, '/')) END AS k, min(page_id) AS page_id FROM pages GROUP BY 1")
def _(spark, d):
    return O.first_per(table(spark, d, "pages").withColumn("k", U.profile_key("url")), "k", [F.asc("page_id")]).select("k", "page_id")


@query(
    "ded_record_linkage",
    """WITH RECURSIVE k AS (SELECT p_partkey AS id, 'b' || p_brand || ':' || p_size || ':' || p_type AS k FROM part UNION ALL SELECT p_partkey, 'p:' || p_retailprice || ':' || p_size FROM part),
    h AS (SELECT k, min(id) AS a FROM k GROUP BY k), e AS (SELECT DISTINCT h.a, k.id AS b FROM k JOIN h USING (k) WHERE h.a <> k.id), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(id, x) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.id, s.b FROM r JOIN s ON s.a = r.x) SELECT id AS p_partkey, min(x) AS entity FROM r GROUP BY id""",
)
def _(spark, d):
    p = table(spark, d, "part")
    keys = F.array(F.concat(F.lit("b"), "p_brand", F.lit(":"), F.col("p_size").cast("string"), F.lit(":"), "p_type"), F.concat(F.lit("p:"), F.col("p_retailprice").cast("string"), F.lit(":"), F.col("p_size").cast("string")))
    return O.link_records(p.withColumn("keys", keys), "p_partkey", "keys")


@query("ded_merge_runs", "WITH r AS (SELECT user_id, min(ts) AS started, max(ts) AS finished FROM events GROUP BY user_id, CAST(ts AS DATE)) SELECT user_id, started FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY started DESC) <= 5")
def _(spark, d):
    runs = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started"))
    return O.newest(runs, ["user_id"], [F.desc("started")], 5).select("user_id", F.col("started").cast("timestamp").alias("started"))


@query(
    "ups_upsert",
    """WITH cur AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'won' END AS stage, TIMESTAMP '2024-01-01' AS seen FROM customer WHERE c_custkey % 2 = 0),
    inc AS (SELECT c_custkey AS id, c_name || ' II' AS name FROM customer WHERE c_custkey % 5 = 0)
    SELECT coalesce(cur.id, inc.id) AS id, coalesce(inc.name, cur.name) AS name, coalesce(nullif(cur.stage, ''), 'new') AS stage,
      CASE WHEN cur.id IS NOT NULL AND inc.id IS NOT NULL THEN 'r0,r1' WHEN inc.id IS NOT NULL THEN 'r1' ELSE 'r0' END AS run_ids,
      coalesce(cur.seen, TIMESTAMP '2024-02-01') AS first_seen, CASE WHEN inc.id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE cur.seen END AS last_seen,
      CASE WHEN cur.id IS NOT NULL AND inc.id IS NOT NULL THEN 'updated' WHEN inc.id IS NOT NULL THEN 'created' ELSE 'kept' END AS change
    FROM cur FULL JOIN inc ON cur.id = inc.id""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    seen = F.lit("2024-01-01").cast("timestamp")
    current = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("won").alias("stage"), F.lit("").alias("notes"), F.array(F.lit("r0")).alias("run_ids"), seen.alias("first_seen"), seen.alias("last_seen"))
    hits = c.filter("c_custkey % 5 = 0")
    twice = hits.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("ord")).unionAll(hits.select("c_custkey", F.concat("c_name", F.lit(" II")), F.lit(2)))
    out = O.upsert(current, twice, key="id", run_id="r1", now=F.lit("2024-02-01").cast("timestamp"))
    return out.select("id", "name", "stage", F.concat_ws(",", "run_ids").alias("run_ids"), "first_seen", "last_seen", "change")


@query("ups_patch", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-02-01' END AS updated_at FROM customer")
def _(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return O.patch(c, c.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment")), "c_custkey", F.lit("2024-02-01").cast("timestamp"))


@query("ups_changed_rows", "SELECT count(*) AS changed FROM customer WHERE upper(c_mktsegment) IS DISTINCT FROM CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END")
def _(spark, d):
    after = F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").filter(~F.upper("c_mktsegment").eqNullSafe(after)).agg(F.count("*").alias("changed"))


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("str_normalize", r"SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS whole FROM documents")
def _(spark, d):
    plain = T.normalize_space("text")
    return table(spark, d, "documents").select("doc_id", F.length(plain).cast("long").alias("n"), F.sha2(plain, 256).alias("whole"))


@query("str_strip_html", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g'))) AS h FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_html("html"), 256).alias("h"))


@query("str_count_terms", "SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'the and')) AS INT) AS n, lower(text) LIKE '%license%' OR lower(text) LIKE '%apache%' AS licensed FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.count_matches("text", ["the", "the and"]).alias("n"), T.includes_any("text", ["license", "Apache"]).alias("licensed"))


@query("str_first_sentence", r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), f AS (SELECT doc_id, t, regexp_extract(t, '^(.*?[.!?])(?:\s|$)', 1) AS s FROM t), g AS (SELECT doc_id, CASE WHEN s = '' THEN t ELSE s END AS s FROM f) SELECT doc_id, CASE WHEN length(s) > 220 THEN left(s, 217) || '...' ELSE s END AS sentence FROM g")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentence("text").alias("sentence"))


@query("str_fold_tokens", "SELECT n_nationkey, regexp_replace(lower(strip_accents(n_name || ' é ñ')), '[^a-z0-9]+', '', 'g') AS folded FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.fold(F.concat("n_name", F.lit(" é ñ"))).alias("folded"))


@query("str_csv_line", """SELECT p_partkey, CASE WHEN regexp_matches(v, '[",\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END AS cell FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "x"' ELSE '' END AS v FROM part)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.csv_cell(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ', "x"').otherwise(""))).alias("cell"))


@query("url_normal_form", f"SELECT page_id, {safe_url_sql('url')} AS url, {domain_sql('url')} AS domain FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.safe_url("url").alias("url"), U.domain_of("url").alias("domain"))


@query("url_record_id", f"SELECT page_id, left(sha1({domain_sql('url')} || '|' || url || '|page ' || page_id), 16) AS id FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.record_id("url", F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("id"))


@query("url_platform_and_bucket", f"WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.linkedin.com/in/p' || page_id WHEN 1 THEN 'https://x.com/p' || page_id WHEN 2 THEN 'https://t.me/p' || page_id ELSE url END AS u FROM pages) SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'X/Twitter' WHEN 2 THEN 'Telegram' ELSE 'Web' END AS platform, CASE page_id % 4 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'x' WHEN 2 THEN 'telegram' ELSE CASE WHEN regexp_matches(lower(u), 'reddit|forum') THEN 'forum' WHEN regexp_matches(lower(u), 'expo|summit|event|speaker|sponsor|registry|fca|cvm') THEN 'ecosystem' ELSE 'web' END END AS bucket FROM u")
def _(spark, d):
    u = F.expr("case page_id % 4 when 0 then 'https://www.linkedin.com/in/p' || page_id when 1 then 'https://x.com/p' || page_id when 2 then 'https://t.me/p' || page_id else url end")
    return table(spark, d, "pages").select("page_id", U.platform_of(u).alias("platform"), S.source_bucket(u).alias("bucket"))


@query("url_blocked_and_referral", rf"""SELECT page_id, regexp_matches({safe_url_sql('url')}, '(?i)favicon|(?:\\n|%5cn|/n[a-z0-9])|\.(?:png|jpe?g|gif|css|js|pdf)/?(?:[?#].*)?$') AS blocked, regexp_matches(lower({url_part('url', 4)} || ' ' || {url_part('url', 5)}), '(?:/r/|register|login|signup|campaign|ref=|referral|affid|lid=)') AS referral FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.is_blocked("url").alias("blocked"), U.is_referral("url").alias("referral"))


@query("url_title", rf"WITH p AS (SELECT page_id, url, list_filter(string_split({url_part('url', 4)}, '/'), lambda x: x <> '') AS parts FROM pages) SELECT page_id, trim(regexp_replace(CASE WHEN len(parts) > 0 THEN regexp_replace(array_to_string(parts[greatest(len(parts) - 1, 1):], ' '), '[-_]', ' ', 'g') ELSE {domain_sql('url')} END, '\s+', ' ', 'g')) AS title FROM p")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", U.title_from_url("url").alias("title"))


@query("url_contact_candidates", f"SELECT page_id, regexp_extract({safe_url_sql('url')}, '^(https?://[^/?#]+)', 1) || '/' || path AS candidate FROM pages, (VALUES ('contact'), ('contact-us'), ('contacts'), ('contato'), ('contacto'), ('about'), ('about-us'), ('partners'), ('partnership'), ('affiliate'), ('affiliates'), ('team')) t(path)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.contact_candidates("url")).alias("candidate"))


@query("arr_extract_contacts", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}'))), ',') AS emails FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", F.array_sort(C.extract_all("text", C.EMAIL))).alias("emails"))


@query("arr_clean_emails", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'maria' || c_custkey || '@acme.com' WHEN 2 THEN '' WHEN 3 THEN 'ana@firm.example2.org' ELSE '' END AS kept FROM customer")
def _(spark, d):
    e = F.expr("case c_custkey % 5 when 0 then 'noreply@acme.com' when 1 then ' Maria' || c_custkey || '@ACME.com' when 2 then '12ab@acme.com' when 3 then 'ana@firm.example2.org' else 'a@b.info' end")
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(",", C.clean_emails(F.array(e, F.lit("x@example.com")))).alias("kept"))


@query("arr_clean_phones", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '+44 20 7946 0958' WHEN c_custkey % 4 = 1 THEN '0044 2079460958' ELSE '' END AS kept FROM customer")
def _(spark, d):
    p = F.expr("case c_custkey % 4 when 0 then '+44  20 7946 0958' when 1 then '0044 2079460958' when 2 then '+20 1012345678' else '4785380592391139' end")
    return table(spark, d, "customer").select("c_custkey", F.concat_ws(",", C.clean_phones(F.array(p))).alias("kept"))


@query("arr_best_contact", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'email' WHEN c_custkey % 2 = 0 THEN 'phone' ELSE 'social' END AS kind, CASE WHEN c_custkey % 3 = 0 THEN 94 WHEN c_custkey % 2 = 0 THEN 90 ELSE 74 END AS confidence FROM customer")
def _(spark, d):
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    emails, phones = F.when(k % 3 == 0, F.array(F.lit("a@b.com"))).otherwise(none), F.when(k % 2 == 0, F.array(F.lit("+44 20 7946 0958"))).otherwise(none)
    found = C.best_contact(emails, phones, F.array(F.lit("https://www.linkedin.com/in/a-b")), none)
    return table(spark, d, "customer").select("c_custkey", found["kind"].alias("kind"), C.contactability(found["kind"]).alias("confidence"))


# --- classification ---------------------------------------------------------------------------------------------------

_VOCAB = {"license": ["licensed under", "license"], "greeting": ["thing", "there"], "roman": ["de la", "que los"]}


@query("cls_first_label", "SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under') OR contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'thing') OR contains(lower(text), 'there') THEN 'greeting' WHEN contains(lower(text), 'de la') OR contains(lower(text), 'que los') THEN 'roman' ELSE 'Unclear' END AS label FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.first_label(S.label_rules("text", _VOCAB), "Unclear").alias("label"))


@query("cls_all_labels", r"SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\b(?:the|and)\b') THEN 'English' END, CASE WHEN regexp_matches(text, '(?i)\b(?:para|los|las)\b') THEN 'Spanish' END, CASE WHEN regexp_matches(text, '(?i)\b(?:der|und|nicht)\b') THEN 'German' END) AS languages FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", S.all_labels(S.word_rules("text", {"English": "the|and", "Spanish": "para|los|las", "German": "der|und|nicht"}), 3)).alias("languages"))


@query("cls_term_score", "SELECT doc_id, CAST(greatest(0, least(100, 18 + least(28, len(regexp_extract_all(lower(text), 'thing')) * 4) + least(18, (len(regexp_extract_all(lower(text), 'with')) + len(regexp_extract_all(lower(text), 'from'))) * 3) + CASE WHEN lang = 'en' THEN 5 ELSE 0 END - CASE WHEN contains(lower(text), 'scum') THEN 18 ELSE 0 END)) AS INT) AS score FROM documents")
def _(spark, d):
    score = S.term_score("text", 18, [(["thing"], 4, 28), (["with", "from"], 3, 18)], [(F.col("lang") == "en", 5), (T.includes_any("text", ["scum"]), -18)])
    return table(spark, d, "documents").select("doc_id", score.alias("score"))


@query("cls_commercial_score", f"WITH {LEADS}, s AS (SELECT id, CAST(greatest(0, least(100, floor(CASE segment WHEN 'BUILDING' THEN 50 WHEN 'MACHINERY' THEN 8 ELSE 28 END + least(18.0, score * 0.18) + CASE WHEN stage = 'contacted' THEN 12 ELSE 0 END + 0.5))) AS INT) AS commercial FROM leads) SELECT id, commercial, CASE WHEN commercial >= 82 THEN 'A' WHEN commercial >= 66 THEN 'B' WHEN commercial >= 48 THEN 'C' ELSE 'D' END AS tier FROM s")
def _(spark, d):
    kind = F.when(F.col("segment") == "BUILDING", "company").when(F.col("segment") == "MACHINERY", "broker_page").otherwise("research_candidate")
    out = leads(spark, d).select("id", S.commercial_score(kind, F.col("score"), [(F.col("stage") == "contacted", 12)]).alias("commercial"))
    return out.withColumn("tier", S.commercial_tier(F.col("commercial")))


@query("prj_outbound", f"WITH {LEADS} SELECT id, CASE WHEN country = 'NATION_3' THEN 'Ola ' || name || ', ' || lower(segment) || '?' ELSE 'Hello ' || name || ', ' || lower(segment) || '?' END AS message FROM leads")
def _(spark, d):
    language = F.when(F.col("country") == "NATION_3", "pt").otherwise("en")
    return leads(spark, d).select("id", S.outbound(language, {"en": "Hello {name}, {what}?", "pt": "Ola {name}, {what}?"}, name=F.col("name"), what=F.lower("segment")).alias("message"))


@query("jsn_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("stm_hourly_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


# --- record policies --------------------------------------------------------------------------------------------------


@query("ded_entity_key", f"WITH p AS (SELECT page_id, url, {domain_sql('url')} AS d, lower(regexp_extract(trim({url_part('url', 4)}, '/'), '^([^/]+)', 1)) AS h FROM pages) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'domain:acme' || page_id || '.com' WHEN h <> '' THEN 'profile:' || d || '/' || h ELSE 'domain:' || d END AS k FROM p")
def _(spark, d):
    none = F.array().cast("array<string>")
    mail = F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("Ana@acme"), "page_id", F.lit(".com")))).otherwise(none)
    return table(spark, d, "pages").select("page_id", Q.entity_key(mail, none, F.col("url"), F.lit("x")).alias("k"))


@query("ded_company_key", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'linkedin:company/c' || page_id WHEN page_id % 5 = 0 THEN 'name:firm-' || page_id ELSE 'domain:' || {domain_sql('url')} END AS k FROM pages")
def _(spark, d):
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.linkedin.com/company/C"), "page_id")).when(F.col("page_id") % 5 == 0, "").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", Q.company_key(u, F.concat(F.lit("Firm: "), "page_id")).alias("k"))


@query("cls_outreach_score", f"""WITH {LEADS}, s AS (SELECT id, bucket, score, stage = 'contacted' AS has, CASE WHEN score >= 76 THEN 'A' WHEN score >= 58 THEN 'B' WHEN score >= 38 THEN 'C' ELSE 'D' END AS p,
  CASE segment WHEN 'BUILDING' THEN 'partner' WHEN 'MACHINERY' THEN 'institution' ELSE 'research' END AS t FROM leads)
SELECT id, CAST(greatest(0, least(100, floor(CASE t WHEN 'partner' THEN 25 WHEN 'institution' THEN 22 ELSE 0 END
  + CASE WHEN bucket IN ('linkedin', 'instagram', 'x', 'telegram') THEN 20 WHEN bucket IN ('myfxbook', 'mql5', 'specialist') THEN CASE WHEN has THEN 12 ELSE 2 END WHEN bucket = 'tradingview' AND has THEN 6 ELSE 0 END
  + least(25.0, score / 4.0) - CASE WHEN bucket = 'mql5' AND NOT has THEN 18 ELSE 0 END - CASE WHEN bucket = 'tradingview' THEN CASE WHEN has THEN 8 ELSE 25 END ELSE 0 END
  - CASE WHEN bucket IN ('mql5', 'myfxbook', 'tradingview', 'specialist', 'forum') AND NOT has THEN 30 ELSE 0 END
  + CASE WHEN p = 'A' AND has THEN 10 WHEN p = 'A' THEN -10 WHEN p = 'D' THEN -20 ELSE 0 END + 0.5))) AS INT) AS outreach FROM s""")
def _(spark, d):
    kind = F.when(F.col("segment") == "BUILDING", "partner").when(F.col("segment") == "MACHINERY", "institution").otherwise("research")
    contact = Q.direct_contact_score(emails=F.col("stage") == "contacted")
    return leads(spark, d).select("id", Q.outreach_score(kind, F.col("bucket"), S.priority(F.col("score")), F.col("score"), contact).alias("outreach"))


@query("prj_qualify", f"""WITH {LEADS}, q AS (SELECT id, bucket, score + CASE WHEN stage = 'contacted' THEN 22 WHEN value > 150000 THEN 18 ELSE 0 END + CASE WHEN commercial_score > 70 THEN 14 ELSE 0 END + CASE WHEN segment = 'BUILDING' THEN 12 WHEN segment = 'MACHINERY' THEN 8 ELSE 0 END - 6 * CASE WHEN score < 65 THEN 1 ELSE 0 END AS total, stage = 'contacted' OR value > 150000 AS strong FROM leads),
t AS (SELECT *, CASE WHEN total >= 105 THEN 'A1 Hot' WHEN total >= 88 THEN 'A2 Strong' WHEN total >= 68 THEN 'B Nurture' ELSE 'C Research' END AS t0 FROM q),
u AS (SELECT id, total, CASE WHEN NOT strong AND t0 LIKE 'A%' THEN 'B Nurture' ELSE t0 END AS tier FROM t)
SELECT id, total, tier, CASE tier WHEN 'A1 Hot' THEN 'High' WHEN 'A2 Strong' THEN 'Medium-High' WHEN 'B Nurture' THEN 'Medium' ELSE 'Low' END AS meeting_priority FROM u""")
def _(spark, d):
    mail, form, no = F.col("stage") == "contacted", F.col("value") > 150000, F.lit(False)
    q = Q.qualify(
        F.col("score"), emails=mail, phones=no, forms=form, links=no, likelihood=F.when(F.col("commercial_score") > 70, "High").otherwise("Low"), hot_segment=F.col("segment") == "BUILDING",
        side_segment=F.col("segment") == "MACHINERY", intent=no, n_flags=(F.col("score") < 65).cast("int"), bucket=F.col("bucket"), strength=F.when(mail | form, "strong").otherwise("none"),
    )
    return leads(spark, d).select("id", q.alias("q")).select("id", "q.*")


@query("cls_best_channel", f"WITH {LEADS} SELECT id, CASE WHEN stage = 'contacted' THEN 'Email' WHEN bucket = 'linkedin' THEN 'LinkedIn' WHEN bucket = 'telegram' THEN 'Telegram' WHEN value > 150000 THEN 'Contact form' ELSE 'Source URL' END AS channel FROM leads")
def _(spark, d):
    has = {"email": F.col("stage") == "contacted", "linkedin": F.col("bucket") == "linkedin", "telegram": F.col("bucket") == "telegram", "form": F.col("value") > 150000}
    return leads(spark, d).select("id", Q.best_channel(has).alias("channel"))


@query("flt_source_categories", f"WITH {LEADS} SELECT 'social' AS category, count(*) AS n FROM leads WHERE regexp_matches(bucket, 'linkedin|instagram|twitter|telegram|discord|tiktok|facebook|threads|reddit') UNION ALL SELECT 'web', count(*) FROM leads WHERE NOT regexp_matches(bucket, 'linkedin|instagram|twitter|telegram|discord|tiktok|facebook|threads|reddit|mql5|myfxbook|specialist|forum') UNION ALL SELECT 'non-mql5', count(*) FROM leads WHERE bucket <> 'mql5' UNION ALL SELECT 'forums', count(*) FROM leads WHERE bucket = 'forum'")
def _(spark, d):
    return O.category_counts(leads(spark, d), {c: Q.in_category(F.col("bucket"), c) for c in ("social", "web", "non-mql5", "forums")})


@query("stm_due_queue", "WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last, CAST(count(*) % 80 AS INT) AS complete, avg(value) > 50 AS hot FROM events GROUP BY 1), a AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last)) / 3.6e9 AS age, CASE WHEN complete < 35 THEN 12 WHEN hot THEN 24 ELSE 168 END AS ttl FROM u), c AS (SELECT user_id, CASE WHEN last IS NULL THEN 'never' WHEN greatest(age, 0) >= ttl THEN CASE WHEN complete < 35 THEN 'contactless_due' ELSE 'scheduled_due' END WHEN greatest(age, 0) >= 72 THEN 'rotation_due' END AS due FROM a) SELECT user_id, due, CASE due WHEN 'contactless_due' THEN 0 WHEN 'never' THEN 1 WHEN 'scheduled_due' THEN 2 WHEN 'rotation_due' THEN 3 ELSE 9 END AS due_rank FROM c")
def _(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).cast("timestamp").alias("last"), (F.count("*") % 80).cast("int").alias("complete"), (F.avg("value") > 50).alias("hot"))
    out = u.select("user_id", Q.due_code(F.lit("2024-01-30").cast("timestamp"), F.col("last"), F.col("complete"), F.col("hot"), contactless_hours=12, hot_hours=24, stale_hours=168, rotation_hours=72).alias("due"))
    return out.withColumn("due_rank", Q.due_priority(F.col("due")))


@query("agg_worker_summary", "WITH w AS (SELECT CAST(user_id % 3 AS VARCHAR) AS worker, event_type AS source, count(*) AS searches, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS raw FROM events GROUP BY 1, 2) SELECT worker, source, CAST(sum(searches) AS BIGINT) AS searches, CAST(sum(raw) AS BIGINT) AS raw, floor(100.0 * sum(raw) / sum(searches) + 0.5) / 100 AS raw_per_search FROM w GROUP BY GROUPING SETS ((worker), (source), ())")
def _(spark, d):
    per = table(spark, d, "events").groupBy((F.col("user_id") % 3).cast("string").alias("worker"), F.col("event_type").alias("source")).agg(F.count("*").alias("searches"), F.sum(F.floor("value")).alias("raw"))
    status = per.groupBy("worker").agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("searches", "raw")))).alias("stats"))
    return R.worker_summary(status, "worker", "stats")


@query("cls_health_issues", f"WITH {LEADS}, f AS (SELECT count(*) AS n, count(*) FILTER (WHERE score >= 50) AS good, count(*) - count(DISTINCT cust) AS dup FROM leads) SELECT 'critical' AS severity, 'empty_db' AS code FROM f WHERE n = 0 UNION ALL SELECT 'warning', 'duplicate_pressure' FROM f WHERE dup > greatest(25, n * 0.08) UNION ALL SELECT 'info', 'has_good_rows' FROM f WHERE good > 0")
def _(spark, d):
    facts = leads(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 50).alias("good"), (F.count("*") - F.countDistinct("cust")).alias("dup"))
    return R.issues(facts, [("critical", "empty_db", F.col("n") == 0), ("warning", "duplicate_pressure", F.col("dup") > F.greatest(F.lit(25.0), F.col("n") * 0.08)), ("info", "has_good_rows", F.col("good") > 0)])


@query("agg_source_chips", f"WITH {LEADS}, c AS (SELECT bucket AS name, count(*) AS n FROM leads GROUP BY 1) SELECT name, n, CASE name WHEN 'linkedin' THEN 1 WHEN 'x' THEN 2 ELSE 3 END AS pos FROM c WHERE name IN ('linkedin', 'x') UNION ALL (SELECT name, n, 3 FROM c WHERE name NOT IN ('linkedin', 'x') ORDER BY n DESC, name LIMIT 5)")
def _(spark, d):
    return R.source_chips(O.count_by(leads(spark, d), F.col("bucket"), name="name"), ["linkedin", "x"])


@query("sup_longer_text", "SELECT c_custkey, CASE WHEN length(c_mktsegment) > length(c_name) THEN c_mktsegment ELSE c_name END AS kept, greatest(c_acctbal, 0) AS touched FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", Q.longer(F.col("c_name"), F.col("c_mktsegment")).alias("kept"), Q.touched_at(F.col("c_acctbal"), F.lit(0.0)).alias("touched"))


# --- extraction and exports -------------------------------------------------------------------------------------------


@query("ext_page_extracts", r"SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) <> '' AS has_heading, CAST(len(regexp_extract_all(html, '<a href=')) AS INT) AS n_links, 0 AS n_forms FROM pages")
def _(spark, d):
    e = P.extract_pages(table(spark, d, "pages"))
    return e.select("page_id", (F.length("title") > 0).alias("has_heading"), F.size("links").alias("n_links"), F.size("forms").alias("n_forms"))


@query("ext_page_contacts")
def _(spark, d):
    e = P.with_contacts(P.extract_pages(table(spark, d, "pages")))
    return e.select("page_id", F.size("emails").alias("n_emails"), F.size("phones").alias("n_phones"), F.size("direct_links").alias("n_direct"), F.size("website_links").alias("n_sites"))


@query("ext_result_anchors", r"WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"(https?://[^\"#]+)', 1)) AS u FROM pages) SELECT page_id, count(*) AS n FROM a GROUP BY 1")
def _(spark, d):
    return P.result_anchors(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("src_api_results", "SELECT user_id, 1 AS rank, 'T' || user_id AS title, 'https://a.example/' || user_id AS url FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 0, 'first', 'https://b.example/' FROM (SELECT DISTINCT user_id FROM events)")
def _(spark, d):
    answer = F.concat(F.lit('{"items": [{"title": "first", "url": "https://b.example/", "description": ""}, {"title": "T'), "user_id", F.lit('", "url": "https://a.example/'), "user_id", F.lit('", "description": null}]}'))
    raw = table(spark, d, "events").select("user_id").distinct().withColumn("answer", answer)
    return api_results(raw, "answer", "items").select("user_id", "rank", "title", "url")


@query("snk_csv_lines", """SELECT CAST(p_partkey AS VARCHAR) || ',' || CASE WHEN contains(v, ',') THEN '"' || replace(v, '"', '""') || '"' ELSE v END || ',' || p_brand || '; ' || p_type AS value FROM (SELECT *, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "x"' ELSE '' END AS v FROM part)""")
def _(spark, d):
    named = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ', "x"').otherwise(""))
    return csv_lines(table(spark, d, "part").select("p_partkey", named.alias("name"), F.array("p_brand", "p_type").alias("tags")))


@query("snk_snapshot", f"WITH {LEADS}, r AS (SELECT id, 'rejected' AS part FROM leads WHERE score < 45 ORDER BY score DESC, last_seen DESC, ord LIMIT 500) SELECT id, 'accepted' AS part FROM leads WHERE score >= 45 UNION ALL SELECT id, part FROM r")
def _(spark, d):
    rows = leads(spark, d)
    return snapshot(rows.filter("score >= 45"), rows.filter("score < 45"), by_score(), 500).select("id", "part")


@query("flagship_ranked_entities", f"WITH {LEADS}, b AS (SELECT * FROM leads WHERE score >= 50 AND segment <> 'MACHINERY' QUALIFY row_number() OVER (PARTITION BY cust ORDER BY {BEST_SQL} DESC, ord) = 1) SELECT cust, name, country, bucket, {BEST_SQL} AS best FROM b ORDER BY best DESC, cust LIMIT 100")
def flagship(spark, d):
    gates = [("low score", F.col("score") < 50), ("segment", F.col("segment") == "MACHINERY")]
    kept = O.with_first_reason(leads(spark, d), gates).filter("reason is null").withColumn("best", best())
    ranked = O.first_per(kept, "cust", [F.desc("best"), F.asc("ord")])
    return ranked.orderBy(F.desc("best"), "cust").limit(100).select("cust", "name", "country", "bucket", "best")
