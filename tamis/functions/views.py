"""What a screen shows and a download holds of a record, and the timeline of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.text import _col
from tamis.sources.sinks import read_table, replace_table

# The columns of a download, in order, and the record's columns that they show where names differ.
DOWNLOAD = (
    "commercialScore", "sourceBucket", "priority", "score", "leadType", "segment", "stage", "name", "country", "languages", "url", "domain", "emails", "socialLinks", "contactLinks", "websiteLinks", "phoneNumbers", "forms",
    "contactQuality", "contactConfidence", "contactSources", "evidence", "outboundDm", "followUp", "snippet",
)
_FROM = {
    "commercialScore": "commercial_score", "sourceBucket": "bucket", "leadType": "lead_type", "socialLinks": "social_links", "contactLinks": "contact_links", "websiteLinks": "website_links", "phoneNumbers": "phone_numbers",
    "contactQuality": "contact_quality", "contactConfidence": "contact_confidence", "contactSources": "contact_sources", "outboundDm": "outbound_dm", "followUp": "follow_up",
}
#: Fixed value: from this score on a record is hot without being marked so.
HOT_SCORE = 76


def some(column: Column | str, kind: str) -> Column:
    """Whether a column of that type holds anything: an element, a positive number, a character."""
    c = _col(column)
    holds = F.size(c) > 0 if kind.startswith("array") else c != "" if kind == "string" else c > 0 if kind in ("int", "bigint", "double") else c
    return F.coalesce(holds, F.lit(False))


def has_contact(df: DataFrame, columns: list[str]) -> Column:
    """FLT-24: whether any of the contact columns holds something."""
    kinds, out = dict(df.dtypes), F.lit(False)
    for c in columns:
        out = out | some(c, kinds[c])
    return out


def is_hot(priority: Column | str, tier: Column | str, commercial: Column | str, score: Column | str) -> Column:
    """FLT-24: marked A by priority or tier, or of a high score; the commercial score counts unless it is null or 0."""
    best = F.coalesce(F.nullif(_col(commercial), F.lit(0)), _col(score), F.lit(0))
    return F.coalesce(_col(priority) == "A", F.lit(False)) | F.coalesce(_col(tier) == "A", F.lit(False)) | (best >= HOT_SCORE)


def quick_view(view: str, hot: Column, contact: Column) -> Column:
    """FLT-24: the rows of a quick view; any other name shows all."""
    return {"hot": hot, "contactable": contact, "no-contact": ~contact}.get(view, F.lit(True))


def download_rows(records: DataFrame) -> DataFrame:
    """SNK-6: records under the 25 names of a download, in its order, ready for `csv_lines`. Forms (arrays of structs page_url,
    action, fields) become texts; columns that the records lack are null."""
    have = dict(records.dtypes)

    def of(name: str) -> Column:
        c = _FROM.get(name, name)
        if c not in have:
            return F.lit(None).cast("string").alias(name)
        if name == "forms":
            return F.transform(c, lambda f: F.concat(F.coalesce(f["page_url"], F.lit("")), F.lit(" -> "), F.coalesce(f["action"], F.lit("")), F.lit(" ("), F.array_join(F.coalesce(f["fields"], F.array().cast("array<string>")), "; "), F.lit(")"))).alias(name)
        return F.col(c).alias(name)

    return records.select(*map(of, DOWNLOAD))


def append_timeline(summary: DataFrame, path: str, at: str = "at", most: int = 500) -> None:
    """SUP-26, SNK-8: adds summaries to a timeline that keeps the newest `most`, as the next version of its table. It holds no
    more than that, so it is one small file."""
    known = read_table(summary.sparkSession, path)
    both = summary if known is None else known.unionByName(summary, allowMissingColumns=True)
    replace_table(both.orderBy(F.desc(at)).limit(most).coalesce(1), path)


def summary_json(df: DataFrame) -> DataFrame:
    """SNK-8: a summary's rows as JSON texts with all fields, nulls too."""
    return df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))
