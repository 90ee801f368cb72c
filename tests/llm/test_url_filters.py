"""Rules against a scan of all rules for each url."""

import random

from tapeworks.llm.url_filters import RULES, filter_urls

RULE_SCHEMA = "host string, path string, verdict string, url string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h.count("."), len(p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[0], f[1], not f[2]), default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in urls], "page_id long, url string, host string, path string").repartition(3)
    table = spark.createDataFrame([(*r, "x") for r in rules], RULE_SCHEMA)
    got = sorted((tuple(r) for r in filter_urls(df, table, ["page_id"]).collect()), key=repr)
    assert got == sorted(((i, *brute(u, rules)) for i, u in urls), key=repr)


def test_awkward(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Example.NET/en/x"), (6, "http://a.b.example.net/en/"), (7, "http://notexample.net/en/"),
        (8, "http://net"), (9, "http://net/"), (10, "x://org/fr/?a#b"), (11, "x://org?/fr/"), (12, "x://a..org/fr/"), (13, "x://org./fr/"), (None, "http://example.com/de/1"),
        (14, "http://example.com/de"), (15, "http://ÉX.net/é"), (16, "http://" + "a." * 3000 + "net/" + "x" * 5000), (17, "u://h.net\n/x"), (18, "a://b://net/"),
    ]
    check(spark, urls + urls[:5] + [(1, "http://net/")] * 50, RULES)


def test_random_nested_rules(spark):
    rnd = random.Random(3)
    hosts = [".".join(rnd.choices(["a", "b", "é"], k=rnd.randint(1, 4))) for _ in range(12)]
    paths = ["", *["/" + "".join(rnd.choices("ab/", k=rnd.randint(0, 5))) for _ in range(12)]]
    rules = sorted({(rnd.choice(hosts), rnd.choice(paths)) for _ in range(60)})
    rules = [(h, p, rnd.choice(["allow", "block"])) for h, p in rules]
    urls = [(i, f"http://{rnd.choice(['', 'a.', 'c.b.'])}{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '/a', '?q', 'b#'])}") for i in range(2000)]
    check(spark, urls, rules)


def test_contradicting_rules_and_empty_tables(spark):
    check(spark, [(1, "http://a.net/")], [])
    check(spark, [], RULES)
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    rules = spark.createDataFrame([("a", "/", "allow", ""), ("a", "/", "block", ""), ("a", None, "allow", "")], RULE_SCHEMA)
    assert filter_urls(df, rules, ["page_id"]).first().verdict == "block"
