import random

from lakewarden.llm import url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def brute(url, rules, default="allow"):
    host, path = split(url)
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1] or "")]
    best = max(fits, key=lambda r: (len(r[0] + (r[1] or "")), len(r[1] or ""), r[2] == "block"), default=None)
    return (host, path, best[0] + (best[1] or "") if best else None, best[2] if best else default)


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.apply_rules(pages, url_filter.rules_frame(spark, rules))
    assert {r.page_id: tuple(r)[1:] for r in got.collect()} == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_nested_rules(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", None, "block"), ("", "/", "block")]
    urls = [None, "", "no scheme", "http://", "http://ORG/x", "http://norg/x", "http://a.example.org/es/1?q=/", "https://example.org/en/12#x", "http://x.com/de/", "http://x.com/DE/", "http://a.com?x", "http://b.a.com#y", "http://org?x", "ftp://u:p@h.org:80/a://b", "http://a..org/", "http://a.com-x.org/", "http://x.com/fr/\n/a", "http://É.ORG/"] * 2
    check(spark, urls, rules)
    check(spark, urls, [])


def test_random_against_brute_force(spark):
    r = random.Random(2)
    host = lambda: ".".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice("xy") for _ in range(r.randint(0, 3)))
    rules = list({(h := host(), p := path()): (h, p, r.choice(["allow", "block"])) for _ in range(60)}.values())
    check(spark, [f"http://{host()}{path()}" for _ in range(400)] + ["http://a.a/x"] * 300, rules)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.apply_rules(pages, url_filter.rules_frame(spark, [("org", "/", "allow")])).count() == 0
