from donorlens.llm.url_filter import HOST_RULES, MAX_BROADCAST_RULES, PATTERNS, Rule, filter_urls

from .common import collected


def judged(spark, urls, rules=HOST_RULES + PATTERNS):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, token string, row int")
    return [tuple(r)[1:5] for r in sorted(filter_urls(pages, rules).collect(), key=lambda r: r["page_id"])]


def test_hosts_and_paths(spark):
    got = judged(
        spark,
        [
            "http://WWW.Example.com/en/1?x#y",
            "https://a.example.com/en/",
            "http://example.com/EN/",
            "http://example.com",
            "http://example.com?x=/en/",
            "http://x.net/es/1",
            "http://xnet/es/1",
            "http://net/fr/://",
            None,
            "",
            "no address",
            "http://",
            "http://notcom/",
            "http://m.casino-win.example.org/1",
            "http://m.casino-wins.example.org/1",
            "http://a.org/" + "x/" * 20_000,
        ],
    )
    assert [g[:1] + g[2:] for g in got[:8]] == [
        ("www.example.com", "www.example.com/en/", "allow"),
        ("a.example.com", "example.com/en/", "block"),
        ("example.com", "com/", "allow"),
        ("example.com", None, "allow"),
        ("example.com", None, "allow"),
        ("x.net", "net/es/", "block"),
        ("xnet", None, "allow"),
        ("net", "net/fr/", "block"),
    ]
    assert got[8:12] == [("", "", None, "allow")] * 4
    assert [g[3] for g in got[12:]] == ["allow", "block", "allow", "allow"]


def test_wildcards_and_rules_without_token(spark):
    rules = (Rule("^shop*buy^", "block"), Rule("ban", "block"), Rule("^a*", "allow"))
    got = judged(spark, ["http://x/shop/1/buy", "http://x/shopping/buy", "http://x/shop-1", "http://x/urban", "http://x/"], rules)
    assert [g[3] for g in got] == ["block", "block", "allow", "block", "allow"]


def test_repeated_and_empty(spark):
    assert judged(spark, []) == []
    assert len(judged(spark, ["http://net/es/"] * 5)) == 5
    pages = spark.createDataFrame([(None, "http://net/es/")] * 3, "page_id long, url string")
    assert collected(filter_urls(pages, HOST_RULES)) == [(None, "net", "/es/", "net/es/", "block", None)] * 3


def test_long_lists_of_rules_give_the_same(spark):
    """More rules than are broadcast, some under a token that most addresses have, one without any token."""
    few = (Rule("^www^", "block"), Rule("||x7.example.org/a", "block", 1), Rule("zzz", "block"), Rule("^p12^", "block"))
    many = few + tuple(Rule(f"^never{i}^", "block") for i in range(50_000))
    assert len(many) > MAX_BROADCAST_RULES
    urls = [f"http://{'www.' if i % 3 else ''}x{i % 50}.example.org/a/p{i % 40}" for i in range(600)]
    urls += ["http://q.org/zzzz", "http://a.net/never77/", "http://a.net/never770000/", None, ""]
    got = judged(spark, urls, many)
    assert got == judged(spark, urls, few)[:601] + [("a.net", "/never77/", None, "block"), *judged(spark, urls, few)[602:]]
