import random
import re
from itertools import combinations, product

from lattica.llm import urls

URLS = [
    None, "", "no scheme/x", "http://a.org/x?y#z", "https://WWW.Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2/", "http://x.com/fr/1", "http://com/de/",
    "http://notcom/de/", "http://a.com?x=/de/", "http://a.com#/de/", "http://a.org", "HTTP://É.com/de/É", "a://b://c.com/de/", "http://xexample.org/es/", "http://example.org/es",
    "http://a.com:80/de/x", "http:///p/q", "http://a.com/d\ne/\n",
]


def brute(url):
    url = url or ""
    if "://" not in url:
        h = p = ""
    else:
        rest = url.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest)[0]
        p = re.match(r"[^?#]*", rest[len(h) :])[0]
        h = re.sub("[A-Z]", lambda m: m[0].lower(), h)
    best = None
    for rh, rp, v in urls.RULES:
        if (h == rh or h.endswith("." + rh)) and p.startswith(rp) and (best is None or len(rh + rp) > len(best[0])):
            best = (rh + rp, v)
    return h, p, *(best or (None, None))


def test_parts_and_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, None, "x")], "page_id long, url string, host string")
    none = urls.mined(spark.createDataFrame([], "tokens array<string>, bad boolean"))
    rows = urls.judged(pages, none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        h, p, rule, verdict = brute(None if r.page_id is None else URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, verdict or "allow"), r


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = urls.op2_urls(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        h, p, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (h, p, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})


def test_mined_rules_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(600):
        host, seg, key = rnd.choice("abcd"), rnd.choice("pqr"), rnd.choice(["", "?ad=1", "?id=2"])
        bad = (host == "a" and key == "?ad=1") or seg == "r" and rnd.random() < 0.95 or rnd.random() < 0.03
        rows.append((f"http://{host}.net/{seg}/{rnd.randint(1, 9)}{key}", bad))
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    data = [(frozenset(r.tokens), r.bad) for r in frame.select(urls.tokens(frame.url).alias("tokens"), "bad").collect()]
    want = {}
    for t in {s for x, _ in data for k in range(1, 6) for s in combinations(sorted(x), k)}:
        bad, n = sum(b for x, b in data if x >= set(t)), sum(x >= set(t) for x, _ in data)
        if bad >= max(12, 0.002 * len(data)) and bad >= 0.9 * n:
            want[frozenset(t)] = bad
    want = {t: n for t, n in want.items() if not any(o < t for o in want)}
    rules = urls.mined(frame.select(urls.tokens(frame.url).alias("tokens"), "bad"))
    # a mined rule stands for every choice of one token from each of its items
    listed = {frozenset(t): r.pages for r in rules.collect() for t in product(*r["items"])}
    assert listed == want and frozenset({"host=a", "query=ad"}) in want
    pages = frame.selectExpr("monotonically_increasing_id() AS page_id", "url")
    texts = {r.page_id: r.url for r in pages.collect()}
    own = {r.url: frozenset(r.tokens) for r in frame.select("url", urls.tokens(frame.url).alias("tokens")).collect()}
    for r in urls.judged(pages, rules).collect():
        hit = sum(all(set(x) & own[texts[r.page_id]] for x in m["items"]) for m in rules.collect()) if r.page_id % 97 == 0 else r.mined_rules
        assert r.mined_rules == hit and r.verdict == ("block" if any(w <= own[texts[r.page_id]] for w in want) else "allow")


def test_deep_paths(spark):
    """Pages that share a path of thirty segments: one item, not 2**30 sets of segments."""
    deep = "/".join("s" * (1 + i) for i in range(30))
    rows = [(f"http://spam.biz/{deep}/{i}?sid={i}", True) for i in range(30)] + [(f"http://fine.net/p/{i}", False) for i in range(60)]
    frame = spark.createDataFrame(rows, "url string, bad boolean")
    rules = urls.mined(frame.select(urls.tokens(frame.url).alias("tokens"), "bad")).collect()
    assert len(rules) == 1 and rules[0].pages == 30 and {"host=spam", "path=s", "path=" + "s" * 30, "query=sid"} <= set(rules[0].anchor)


def test_whole_query_with_a_planted_host(spark, tmp_path):
    """Labels with a signal: pages of one host and query key are toxic, the rest are labelled at random."""
    rnd, pages, labels = random.Random(12), [], []
    for i in range(2000):
        bad = i % 10 == 0
        pages.append((i, f"https://{'casino-win' if bad else rnd.choice(['alpha', 'beta', 'gamma'])}.net/{rnd.choice('abcd')}/{i}{'?ref=1' if bad or i % 3 == 0 else ''}", "x"))
        if i % 2 == 0:
            labels.append((i, int(not (bad or rnd.random() < 0.2)), int(bad and rnd.random() < 0.5)))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r.verdict for r in urls.op2_urls(spark, str(tmp_path)).collect()}
    assert got == {i: "block" if i % 10 == 0 else "allow" for i in range(2000)}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urls.judged(pages, urls.mined(urls.labelled_pages(pages, labels))).count() == 0
