"""A crawl in rounds against one address at a time."""

import random

import pytest

from tamis.operators.crawl import crawl_links


def slowly(seeds, links, depth, per_site, total):
    out, used = {}, {}
    candidates = seeds
    for level in range(depth + 1):
        first = {}
        for url, site, ord_ in candidates:
            if url is not None and url not in out:
                first[url] = min(first.get(url, (ord_, site)), (ord_, site), key=lambda x: x[0])
        # A site's budget is used up in order, then the total.
        fits, n = [], {}
        for url, (ord_, site) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
            n[site] = n.get(site, 0) + 1
            if n[site] + used.get(site, 0) <= per_site:
                fits.append((url, site, ord_))
        fits = fits[: total - len(out)]
        for url, site, ord_ in fits:
            out[url] = (site, level, ord_)
            used[site] = used.get(site, 0) + 1
        new = {url for url, _, _ in fits}
        candidates = [(dst, site, ord_) for src, dst, site, ord_ in links if src in new]
    return sorted((u, *v) for u, v in out.items())


@pytest.mark.parametrize(("depth", "per_site", "total"), [(3, 4, 25), (5, 100, 1000), (0, 2, 3)])
def test_budgets(spark, depth, per_site, total):
    rng = random.Random(depth)
    site = lambda i: None if i % 9 == 0 else f"s{i % 4}"
    links = [(rng.randrange(60), dst, site(dst), n) for n, dst in enumerate(rng.randrange(60) for _ in range(150))]
    links += [(3, None, "s1", 500), (None, 7, "s3", 501), (3, 3, "s3", 502)] + [(3, 100 + i, "hot", 600 + i) for i in range(40)]
    seeds = [(3, "s3", 1), (12, "s0", 2), (3, "s3", 5), (18, None, 3), (None, "s1", 0)]
    found = crawl_links(spark.createDataFrame(seeds, "url long, site string, ord long"), spark.createDataFrame(links, "src long, dst long, site string, ord long"), depth=depth, per_site=per_site, total=total)
    assert sorted(tuple(r) for r in found.collect()) == slowly(seeds, links, depth, per_site, total)
