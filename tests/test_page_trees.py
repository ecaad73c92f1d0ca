"""Nodes, selectors and the results of three engines on fixture pages."""

from pyspark.sql import functions as F

from tamis.sources import page_trees as P

PAGE = '<html><head><title>T &amp; t</title><style>p{}</style></head><body><ul><li class="a b">one<li>two <a href="/x" id="k">go <b>there</b></a></ul><p>open<p>next<br>line<div class=b><div>in</div>tail</div><script>"<p>"</script></body></html>'


def shown(df):
    return sorted((r["name"], r["text"]) for r in df.collect())


def test_nodes_and_selectors(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "no tags <b>but</i> one"), (4, "<rss><item><link>https://a.example/</link></item></rss>")], "page_id int, html string")
    nodes = P.page_nodes(pages)
    assert sorted((r["page_id"], r["text"]) for r in nodes.filter("pre = 0").collect()) == [(1, "T & tonetwo go thereopennextlineintail"), (2, ""), (3, "no tags but one"), (4, "https://a.example/")]
    for r in nodes.collect():
        assert r["pre"] <= r["last"] and r["start"] <= r["stop"] and (r["text"] is None) == (r["pre"] > 0)
    found = P.with_text(P.matched(nodes, {"li": ["li"], "second": ["ul a"], "both": ["li.a", ".b"], "deep": ["body div.b div"], "p": ["p"], "marks": ["ul li a[href]#k b"], "none": ["ol li", "a.b"], "link": ["link"], "bold": ["b"]}), nodes)
    assert shown(found) == sorted([("li", "one"), ("li", "two go there"), ("second", "go there"), ("both", "one"), ("both", "intail"), ("deep", "in"), ("p", "open"), ("p", "nextline"), ("marks", "there"), ("link", "https://a.example/"), ("bold", "there"), ("bold", "but one")])


def duck(n):
    hit = lambda i: f'<div class="result web-result"><div class="result__body"><h2 class="result__title"><a class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fs{i}.example%2Fp&amp;rut=1">Title <b>{i}</b></a></h2><a class="result__snippet" href="x">About {i} &amp; more</a></div></div>'
    return "<html><body><div class='nav'><a href='https://no.example/'>no</a></div>" + "".join(hit(i % 11) for i in range(n)) + "</body></html>"


def test_results_of_three_engines(spark):
    bing = '<ol><li class="b_algo x"><h2><a href="https://one.example/a">One</a></h2><div class="b_caption"><p>First <i>text</i></p><p>second</p></div></li><li class="b_ad"><h2><a href="https://ad.example/">Ad</a></h2></li><li class="b_algo"><h2><a href="https://two.example/">Two</a></h2>rest</li><li class="b_algo"><h2>no link</h2></li><li class="b_algo"><h2><a href="https://one.example/a">Again</a></h2></li></ol>'
    rss = '<?xml version="1.0"?><rss><channel><link>https://feed.example/</link><item><title>A &amp; B</title><link>https://r.example/1</link><description><![CDATA[Text 1]]></description></item><item><title>C</title><link>https://r.example/2</link></item></channel></rss>'
    pages = [(1, "duckduckgo", duck(13)), (2, "duckduckgo", duck(0)), (3, "duckduckgo", duck(1)), (4, "bing", bing), (5, "bing-rss", rss), (6, "other", duck(3)), (7, "bing", None)]
    found = P.search_results(spark.createDataFrame(pages, "page_id int, engine string, html string")).orderBy("page_id", "rank").collect()
    rows = {}
    for r in found:
        rows.setdefault(r["page_id"], []).append((r["url"], r["title"], r["snippet"]))
    assert rows[1] == [(f"https://s{i}.example/p", f"Title {i}", f"About {i} & more") for i in range(11)] and 2 not in rows and rows[3] == rows[1][:1]
    assert rows[4] == [("https://one.example/a", "One", "First text"), ("https://two.example/", "Two", "Tworest")]
    assert rows[5] == [("https://r.example/1", "A & B", "Text 1"), ("https://r.example/2", "C", "")] and set(rows) == {1, 3, 4, 5}


def test_matching_is_by_ranges_within_pages(spark):
    nodes = P.page_nodes(spark.createDataFrame([(1, PAGE)], "page_id int, html string"))
    plan = P.matched(nodes, {"x": ["ul li a"]})._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert P.matched(nodes, {}).count() == 0 and P.page_nodes(nodes.select("page_id", F.lit("").alias("html")).limit(0)).count() == 0


def test_named_references_only(spark, tmp_path):
    html = '<head><title>a &amp; b &quot;c&quot; &amp;lt; cut &amp</title></head><body><a href="?x=1&y=2&amp;z">&#39;</a><![CDATA[p & q]]></body>'
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    text = lambda **k: P.page_nodes(pages, **k).filter("pre = 0").first()["text"]
    assert text() == 'a & b "c" &lt; cut &\'p & q'
    assert text(references=["amp"]) == "a & b &quot;c&quot; &lt; cut &amp&#39;p & q" and text(references=["amp", "quot", "#39"]) == 'a & b "c" &lt; cut &amp\'p & q'
    assert text(references=[]) == "a &amp; b &quot;c&quot; &amp;lt; cut &amp&#39;p & q"
    assert P.page_nodes(pages, references=["amp"]).filter("href is not null").first()["href"] == "?x=1&y=2&z"
    # The query as its SQL has it.
    from __spark_entry__ import queries

    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert shown(queries()["ext_page_trees"](spark, str(tmp_path))) == [("title", "a & b &quot;c&quot; &lt; cut &amp")]
