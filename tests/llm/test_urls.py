from treeblock.llm import urls as U

URLS = [
    "http://a.net/x", "https://A.B.Net/", "http://net", "http://net/", "http://xnet/", "http://example.net/en/1", "http://m.example.net/en/", "http://example.net/en", "http://example.net/?q=/en/",
    "http://example.com/de/x#y", "http://example.com/DE/x", "http://w.example.org/fr/825?page=2", "no scheme", None, "", "://net/", "http://a.net:80/", "http://a.net/x://b.org/fr/", "http://u@a.net/", "http://a..net/",
]


def brute(url, rules):
    rest = (url or "").partition("://")
    host = path = ""
    if rest[1]:
        tail = rest[2]
        end = min([i for i in (tail.find(c) for c in "/?#") if i >= 0], default=len(tail))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in tail[:end])
        path = tail[end:].partition("#")[0].partition("?")[0]
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            key = (len(rule), verdict == "allow")
            best = max(best, (key, rule, verdict)) if best else (key, rule, verdict)
    return (host, path, best[1] if best else None, best[2] if best else "allow")


def test_equals_brute_force(spark):
    rules = [*U.RULES, ("b.net/x", "allow"), ("a.net/x", "block"), ("org", "block")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0])], "page_id long, url string").selectExpr("*", "'x' as host", "1 as rule")
    out = U.judged(pages, spark.createDataFrame(rules, "rule string, verdict string"))
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in out.collect())
    want = [(i, *brute(u, rules)) for i, u in enumerate(URLS)] + [(0, *brute(URLS[0], rules))]
    assert got == sorted((i, h, p, r or "", v) for i, h, p, r, v in want)


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame(U.RULES, "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.judged(pages, rules.limit(0), "block").first().verdict == "block"
    assert U.judged(pages.limit(0), rules).count() == 0
    nulls = spark.createDataFrame([(None, "block"), ("net/", "block")], "rule string, verdict string")
    assert U.judged(pages, nulls).first().rule == "net/"


def test_many_rules_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 1)
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.de/")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judged(pages, spark.createDataFrame(U.RULES, "rule string, verdict string")).collect()} == {1: "block", 2: "allow"}
