"""Hand-written edge rows of the expressions."""

from pyspark.sql import functions as F

from tamis.functions import contacts as C
from tamis.functions import discovery as D
from tamis.functions import ownership as W
from tamis.functions import qualify as Q
from tamis.functions import scoring as S
from tamis.functions import text as T
from tamis.functions import urls as U


def values(spark, rows, expr, schema="v string"):
    """The expression's values over the rows' column v, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_space_and_sentences(spark):
    assert values(spark, ["a  b\n", None, ""], T.normalize_space("v")) == ["a b", "", ""]
    assert values(spark, ["One. Two", "no end", ""], T.first_sentence("v", "none")) == ["One.", "no end", "none"]
    assert len(values(spark, ["x" * 400], T.first_sentence("v"))[0]) == 220


def test_terms_count_nested_ones_twice(spark):
    assert values(spark, ["Forex trader and trader", None], T.count_matches("v", ["trader", "forex trader"])) == [3, 0]
    assert values(spark, ["SEÑALES", "nothing"], T.includes_any("v", ["señales"])) == [True, False]


def test_word_edges_are_ascii(spark):
    assert values(spark, ["ñforex", "xforex", "forex"], T.contains_word("v", "forex")) == [True, False, True]


def test_falsy_skips_zero_and_empty(spark):
    df = spark.createDataFrame([(0, 50), (7, 50), (None, None)], "a int, b int")
    assert [r["x"] for r in df.select(T.falsy("a", "b").alias("x")).collect()] == [50, 7, None]


def test_urls(spark):
    given = ["https://www.Acme.com", "HTTPS://acme.com/#x", "ftp://a.b", "not a url", "http://a.com:80/b?c=d", "https://a.com/a b"]
    assert values(spark, given, U.safe_url("v")) == ["https://www.acme.com/", "https://acme.com/", None, None, "http://a.com/b?c=d", "https://a.com/a%20b"]
    assert values(spark, given[:4], U.domain_of("v")) == ["acme.com", "acme.com", "", ""]
    assert values(spark, ["https://sub.linkedin.com/in/a-b", "https://x.com/home", "https://netflix.com/", ""], U.platform_of("v")) == ["LinkedIn", "X/Twitter", "Web", ""]
    assert values(spark, ["https://news.com/", "https://a.com/x.png", "https://a.com/x"], U.is_blocked("v")) == [True, True, False]
    assert values(spark, ["https://a.com/?ref=x", "https://a.com/?valid=1", "https://a.com/"], U.is_referral("v")) == [True, True, False]
    assert values(spark, ["sub.a.co.uk"], U.domain_suffixes("v")) == [["sub.a.co.uk", "a.co.uk", "co.uk", "uk"]]
    assert values(spark, ["https://r.search.example/RU=https%3a%2f%2facme.com%2fp/RK=2", "https://s.example/?uddg=https%3A%2F%2Facme.com", "https://acme.com/q"], U.unwrap_redirect("v")) == ["https://acme.com/p", "https://acme.com/", "https://acme.com/q"]
    assert values(spark, ["https://a.com/our-team/john_doe", "https://a.com/"], U.title_from_url("v")) == ["our team john doe", "a.com"]
    assert values(spark, ["https://www.linkedin.com/in/A-b/", "https://x.com/Foo", "https://a.com/B/"], U.profile_key("v")) == ["linkedin:in/a-b", "x:foo", "url:a.com/b"]


def test_contacts(spark):
    mails = [["Maria@acme.com", "maria@acme.com", "noreply@acme.com", "12ab@acme.com", "a@b.info", "x@example.com", ""]]
    assert values(spark, mails, C.clean_emails("v"), "v array<string>") == [["maria@acme.com", "maria@acme.com"]]
    phones = [["+44 20 7946 0958", "+1 (743) 555-3824", "4785380592391139", "+20 1012345678", "0044 2079460958"]]
    assert values(spark, phones, C.clean_phones("v"), "v array<string>") == [["+44 20 7946 0958", "+1 (743) 555-3824", "0044 2079460958"]]
    links = ["https://www.linkedin.com/in/a-b", "https://instagram.com/p/", "https://instagram.com/ana", "https://wa.me/4412345678", "https://t.me/share", "https://acme.com/x"]
    assert values(spark, links, C.is_direct_contact("v")) == [True, False, True, True, False, False]


def test_forms(spark):
    kind = "v array<struct<page_url:string,action:string,method:string,fields:array<string>,label:string>>"
    contact = ("https://a.com/contact", "https://a.com/send", "post", ["message", "email"], "")
    login = ("https://a.com/", "https://a.com/login", "post", ["user", "password"], "")
    nowhere = ("", "", "get", ["message", "email"], "contact")
    found = values(spark, [[contact, login, nowhere, contact], []], C.clean_forms("v"), kind)
    assert [len(x) for x in found] == [1, 0]


def test_tiers(spark):
    scores = [105, 104, 88, 87, 68, 67]
    assert values(spark, scores, S.icp_tier(F.col("v")), "v int") == ["A1 Hot", "A2 Strong", "A2 Strong", "B Nurture", "B Nurture", "C Research"]
    assert values(spark, [76, 75, 58, 57, 38, 37], S.priority(F.col("v")), "v int") == ["A", "B", "B", "C", "C", "D"]
    assert values(spark, [82, 81, 66, 65, 48, 47], S.commercial_tier(F.col("v")), "v int") == ["A", "B", "B", "C", "C", "D"]
    assert values(spark, ["A1 Hot", "C Research", "odd"], S.cap_tier(F.col("v"), F.lit("B Nurture"))) == ["B Nurture", "C Research", "odd"]
    assert values(spark, ["see netflix.com", "plain", "LinkedIn post on mql5"], S.source_bucket(F.col("v"))) == ["x", "web", "mql5"]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_direct_contacts_of_more_hosts(spark):
    good = ["https://wa.me/441234567890", "https://api.whatsapp.com/send?phone=441234567890", "https://www.tiktok.com/@ana", "https://facebook.com/ana.page", "https://facebook.com/groups/g1", "https://www.linkedin.com/feed/update/1", "https://mql5.com/en/users/ana", "https://solo.to/ana", "https://old.reddit.com/user/ana"]
    bad = ["https://wa.me/", "https://web.whatsapp.com/", "https://tiktok.com/ana", "https://facebook.com/watch", "https://facebook.com/a/b", "https://mql5.com/en/market/x", "https://solo.to/pricing", "https://sub.x.com/ana", "https://a.t.me/ana", "https://linkedin.com/jobs/1"]
    found = one(spark, *(C.is_direct_contact(F.lit(u)).alias(f"c{i}") for i, u in enumerate(good + bad)))
    assert found == (True,) * len(good) + (False,) * len(bad)


def test_mail_rules_and_folding(spark):
    mails = F.array(*map(F.lit, ["a.b@firm.com", "x@broker.example", "x@sub.broker.example", "ana@host.method", "facebookfacebook@firm.com", "ana@firm.com"]))
    assert one(spark, C.clean_emails(mails, broker_hosts=["broker.example"])) == (["a.b@firm.com", "ana@firm.com"],)
    assert one(spark, T.fold(F.lit("Čašćż ő Nguyễn")), T.fold(F.lit("éa"))) == ("casczonguyen", "ea")
    assert one(spark, T.decode_loose(F.lit("a\\u0026b\\/c&amp;d%20e+f")), T.decode_loose(F.lit("50% off")), T.decode_loose(F.lit(None).cast("string"))) == ("a&b/c&d e+f", "50% off", "")


def test_ownership(spark):
    p = W.Platforms(hosts=["hub.example"], widgets=["chat.example"], free_mail=["free.example"], handles=["brandname"], generic_words=["trader"])
    urls = ["https://hub.example/u/ana", "https://a.chat.example/x", "https://x.com/@BrandName", "https://own.example/ana", ""]
    assert one(spark, *(W.is_owned_url(F.lit(u), F.lit("https://own.example"), p) for u in urls)) == (True, True, True, False, True)
    words = W.identity_words(F.lit("Ána-María Trader"), p)
    mails = ["maria.l@free.example", "other@free.example", "info@own.example", "x@hub.example", "who@own.example", "", None]
    assert one(spark, *(W.is_owned_email(F.lit(m), F.lit("https://hub.example/u/m"), words, p) for m in mails)) == (False, True, True, True, False, True, True)
    assert one(spark, W.is_owned_email(F.lit("other@free.example"), F.lit("https://own.example"), words, p), W.handle_of(F.lit("https://www.linkedin.com/in/Ana-B/")), W.handle_of(F.lit("nothing"))) == (False, "ana-b", "")
    links = F.array(*map(F.lit, ["https://linkedin.com/in/ana-b", "https://linkedin.com/in/ana-b", "https://linkedin.com/jobs/1", "https://own.example/"]))
    people = F.array(F.struct(F.lit("").alias("name"), F.lit("Ana B - Founder").alias("title"), F.lit("").alias("url")), F.struct(F.lit("").alias("name"), F.lit("").alias("title"), F.lit("").alias("url")))
    (found,) = one(spark, W.makers(people, links))
    assert [(r["name"], r["url"]) for r in found] == [("Ana B", ""), ("in ana b", "https://linkedin.com/in/ana-b")]
    assert one(spark, W.bare_websites(F.lit("see www.firm.example/a, (www.firm.example/a) or mail"))) == (["https://www.firm.example/a"],)
    forms = F.array(F.struct(F.lit("https://f.example/").alias("page_url"), F.lit("/send").alias("action"), F.array(F.lit("email"), F.lit("text")).alias("fields")))
    assert one(spark, W.forms_summary(forms), W.people_summary(people)) == (["https://f.example/ -> /send [email; text]"], ["Ana B - Founder", ""])


def test_discovery(spark):
    html = '<script>{"ownerChannelName":"Ana","subscriberCountText":{"simpleText":"12K"},"shortDescription":"say \\"hi\\" now"}</script>'
    assert tuple(one(spark, D.video_info(F.lit(html)))[0]) == ("Ana", "12K", 'say \\"hi\\" now')
    assert tuple(one(spark, D.video_info(F.lit(None).cast("string")))[0]) == (None, None, None)
    aliases, tokens = D.aliases_of(F.lit("Ana María López Trading"), ["trading"])
    hit = lambda t, c=None: D.matches_identity(F.lit(t), aliases, tokens, c)
    assert one(spark, hit("ana maria lopez trading profile"), hit("maria from lopez"), hit("maria only"), hit("maria only", F.lit(True)), hit("")) == (True, True, False, True, False)
    assert one(spark, D.contact_queries(F.lit(" "), ["{name} x"]), D.contact_queries(F.lit("A"), ["{name} {name}"])) == ([], ["A {name}"])


def test_links_names_and_lists(spark):
    links = F.array(*map(F.lit, ["https://instagram.com/ana", "https://firm.example/contact", "https://firm.example/"]))
    (found,) = one(spark, C.split_links(links, ["instagram.com"]))
    assert (found["social"], found["contact"], found["website"]) == (["https://instagram.com/ana"], ["https://instagram.com/ana", "https://firm.example/contact"], ["https://firm.example/contact", "https://firm.example/"])
    assert one(spark, C.chat_link(F.lit("+44 1234 5678")), C.chat_link(F.lit("123")), C.normal_chat_link(F.lit("https://wa.me/"))) == ("https://wa.me/4412345678", None, "https://wa.me/")
    assert one(spark, T.clean_identity(F.lit("@Ana Lopez (official) - Trader")), T.is_useful_identity(F.lit("forex"), "forex|gold"), T.is_useful_identity(F.lit("Ana"), "forex")) == ("Ana Lopez", False, True)
    assert one(spark, T.names_in_text(F.lit("Ask Ana Lopez or Juan Carlos Diaz via @ana_fx, ana@x.example"))) == (["Ask Ana Lopez", "Juan Carlos Diaz", "ana_fx"],)
    assert one(spark, Q.client_category(F.lit("Own site"), "web"), Q.client_category(F.lit("a Blog"), "blog"), Q.client_category(F.lit("mql5"), "web")) == (True, True, False)


def test_clean_contacts(spark):
    p = W.Platforms(hosts=["hub.example"], free_mail=["free.example"], handles=["hub"])
    schema = "id int, url string, name string, title string, emails array<string>, phones array<string>, links array<string>, websites array<string>, forms array<string>, best_contact string, best_type string"
    rows = [
        (1, "https://hub.example/u/a", "Ana Lopez", "", ["other@free.example", "lopez@free.example"], [], ["https://hub.example/u/a"], [], [], "https://hub.example/u/a", "social"),
        (2, "https://own.example", "B", "", [], ["+44 20 7946 0958"], [], ["https://hub.example/x", "https://b.example/"], [], "someone@b.example", "email"),
        (3, "https://own.example", "C", "", None, None, None, None, None, None, None),
    ]
    one_, two, three = W.clean_contacts(spark.createDataFrame(rows, schema), p).orderBy("id").collect()
    assert (one_["emails"], one_["links"], one_["best_contact"], one_["best_type"]) == (["lopez@free.example"], [], "lopez@free.example", "email")
    assert (two["websites"], two["best_contact"], two["best_type"]) == (["https://b.example/"], "someone@b.example", "email")
    assert (three["best_contact"], three["best_type"]) == (None, None)


def test_first_sentence_reads_only_what_it_needs(spark):
    from pyspark.sql import functions as F

    from tamis.functions import text as T

    texts = ["", " \n ", "One. Two", "a" * 219 + ". b", "a" * 220 + ". b", "a" * 220, "a" * 221, "ab  " * 74 + ". c", "　x" * 300, "x\u0085y. z", "no end " * 500, "a.b" * 90 + " c. d", "😀 " * 111 + "!", "q?\n\n" + "r" * 9999, None, "w " * 110 + "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    t = T.normalize_space("text")
    s = F.regexp_extract(t, r"^(.*?[.!?])(?:\s|$)", 1)
    s = F.when(s == "", t).otherwise(s)
    whole = F.when(F.length(s) > 220, F.concat(F.substring(s, 1, 217), F.lit("..."))).otherwise(s)
    assert df.filter(~T.first_sentence("text").eqNullSafe(whole)).collect() == []
    plan = df.select(T.first_sentence("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "{0,222}" in plan
