from locusmill.llm import reputation as rep
from locusmill.llm.queries import URL_RULES

from .oracle import check


def judged(spark, urls, outcomes=(), **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    good = spark.createDataFrame(list(outcomes), "url string, good int")
    return {r.page_id: r for r in rep.judge(pages, good, URL_RULES, **more).collect()}


def test_rules_and_parts(spark):
    urls = [
        "http://A.example.NET/en/x?q", "https://example.net/fr/", "http://org/fr/", "http://x.org/fr", "http://com/", None,
        "no scheme", "http://example.com/de/#x", "http://notnet/", "http://a.net", "x://b://c/d", "http://example.com?a=/de/", "",
    ]
    got = judged(spark, urls)
    want = [
        ("a.example.net", "/en/x", "example.net/en/"), ("example.net", "/fr/", "net/"), ("org", "/fr/", "org/fr/"),
        ("x.org", "/fr", None), ("com", "/", None), ("", "", None), ("", "", None), ("example.com", "/de/", "example.com/de/"),
        ("notnet", "/", None), ("a.net", "", None), ("b:", "//c/d", None), ("example.com", "", None), ("", "", None),
    ]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    assert [got[i].verdict for i in (0, 1, 2, 7)] == ["allow", "block", "allow", "block"]


def test_shrinking(spark):
    urls = ["http://a.good.com/", "http://new.good.com/", "http://a.bad.com/", "http://new.bad.com/", "http://other.com/"]
    outcomes = [("http://a.good.com/1", 1)] * 200 + [("http://a.bad.com/1", 0)] * 200 + [("http://b.bad.com/1", 0)] * 50 + [(None, None)]
    got = judged(spark, urls, outcomes)
    assert [got[i].verdict for i in range(4)] == ["allow", "allow", "block", "block"]
    assert got[0].bound > got[1].bound > got[4].bound > got[3].bound
    assert not judged(spark, [], outcomes)


def test_suffix(spark):
    names = ["a.b.co.uk", "b.com", "10.0.0.1", "localhost", "u@x.y.org:80", "co.uk", ""]
    df = spark.createDataFrame([(n,) for n in names], "host string")
    domain, suffix = rep.domain_and_suffix("host")
    got = [tuple(r) for r in df.select(domain, suffix).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.com", "com"), ("10.0.0.1",) * 2, ("localhost",) * 2, ("y.org", "org"), ("co.uk", "uk"), ("", "")]


def test_sql(spark):
    check(spark, "op2_url_reputation")
