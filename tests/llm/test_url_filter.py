import random

from pitengine.llm import url_filter as U

RULES = [*U.RULES, ("example.com", "/en/a", "allow"), ("example.com", "/en/ab/", "block"), ("b.example.com", "/", "block"), ("ample.com", "/", "block"), ("com", "/en/abcdefgh", "block"), ("org", "", "block"), ("x.org", "/\u00e9", "allow")]


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), h + p, v))
    return host, path, best and best[2], best[3] if best else "allow"


def test_matches_brute_force(spark, sf):
    rnd = random.Random(3)
    part = lambda xs, n: "".join(rnd.choice(xs) for _ in range(n))
    urls = [None, "", "no scheme", "://", "http://", "https://COM", "http://a.com?x=/en/", "http://a.com#://b.net/es/", "x\n://example.com/en/\nq", "http://.com/", "http://example.com./en/", "http://xexample.com/en/ab/c", "http://\u00c9.ORG/\u00e9", "http://x.org/\u00e9\u00e9?\u00e9"]
    for _ in range(400):
        host = ".".join(rnd.choice(["www", "b", "ample", "x", "example"]) for _ in range(rnd.randrange(3))) + rnd.choice([".example.com", "example.com", ".net", "net", ".org", ".com"])
        urls.append(f"http{part('s', rnd.randrange(2))}://{host}{rnd.choice(['', '/', '/en', '/en/', '/en/a', '/en/ab/', '/es/x', '/fr/'])}{part('ab/defgh', rnd.randrange(6))}{rnd.choice(['', '?q=/en/', '#t'])}")
    urls += ["http://example.com/en/ab/"] * 300
    pages = spark.createDataFrame([(k if k % 50 else None, u, "h", "k") for k, u in enumerate(urls)], "page_id long, url string, host string, key string").repartition(5)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for some, plain_rules in ((rules, RULES), (rules.limit(0), [])):
        got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in U.judge(pages, some).collect())
        want = sorted((str(k if k % 50 else None), *(str(x) if j == 2 else x for j, x in enumerate(plain(u, plain_rules)))) for k, u in enumerate(urls))
        assert got == want
    assert U.judge(pages.limit(0), rules).count() == 0
