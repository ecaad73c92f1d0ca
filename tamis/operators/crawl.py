"""A crawl over captured links in rounds, under budgets of depth, pages a site and pages in all.

A round joins the frontier with the links, leaves out what was visited, and takes new addresses in the order of their first
link until a site's budget, then the total, is used up. Each round's addresses are written to the shared folder, so a lost
executor costs a round. Nothing but numbers (addresses taken in a round) reaches the driver, and a site of very many
candidates is cut to its budget before its rows meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.components import remove_path, stored


def crawl_links(seeds: DataFrame, links: DataFrame, *, depth: int, per_site: int, total: int) -> DataFrame:
    """EXT-8: (url, site, depth, ord) of the addresses that are visited. seeds (url, site, ord) are depth 0 and count for the
    budgets too; links (src, dst, site, ord) have the target's site; `ord` fixes the order, with the address after it. Null
    addresses lead nowhere; a null site is one; an address that comes again is visited once, where it comes first."""
    paths: list[str] = []

    def taken(found: DataFrame, before: DataFrame | None, level: int, left: int) -> DataFrame:
        """The candidates (url, site, ord) that fit into what is left."""
        one = found.filter("url is not null").groupBy("url").agg(F.min(F.struct("ord", "site")).alias("f")).select("url", "f.site", "f.ord")
        place = F.row_number().over(Window.partitionBy("site").orderBy("ord", "url"))
        # The bound by a number lets Spark cut each task's share of a site first.
        few = one.withColumn("_n", place).filter(F.col("_n") <= per_site)
        if before is not None:
            used = before.groupBy(F.col("site").alias("_site")).agg(F.count("*").alias("_used"))
            few = few.join(used, F.col("site").eqNullSafe(F.col("_site")), "left").filter(F.col("_n") + F.coalesce("_used", F.lit(0)) <= per_site)
        return stored(few.orderBy("ord", "url").limit(left).select("url", "site", F.lit(level).alias("depth"), "ord"), "visited", paths)

    rounds = [taken(seeds.select("url", "site", "ord"), None, 0, total)]
    left = total - rounds[0].count()
    for level in range(1, depth + 1):
        if left <= 0:
            break
        visited = reduce(DataFrame.union, rounds)
        frontier = rounds[-1].select(F.col("url").alias("src"))
        found = links.join(frontier, "src").select(F.col("dst").alias("url"), "site", "ord").join(visited.select("url"), "url", "left_anti")
        now = taken(found, visited, level, left)
        n = now.count()
        if not n:
            break
        rounds.append(now)
        left -= n
    out = stored(reduce(DataFrame.union, rounds), "crawled")
    for p in paths:
        remove_path(seeds.sparkSession, p)
    return out
