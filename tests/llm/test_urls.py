import math
import re
from collections import Counter, defaultdict

import duckdb

from tuplespace.llm.queries import op6_url_ratio
from tuplespace.llm.urls import EVEN_CHANCE, ORDER, filter_urls, gram_ratios, urls_sql

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]


def judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


def twin(pages):
    con = duckdb.connect()
    con.register("pages", pages)
    return sorted(con.sql(urls_sql()).fetchall(), key=str)


def test_query_rules(spark, sf_small):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    got = op6_url_ratio(spark, sf_small).collect()
    assert sorted(r.page_id for r in got) == sorted(urls)
    for r in got:
        host, path, rule, verdict = judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_models_tell_kinds_apart_and_edges(spark, rng):
    urls = [f"https://{rng.choice(['a', 'b', 'c'])}.org/news/{rng.randint(0, 999)}" for _ in range(80)]
    urls += [f"http://{rng.choice('pqr')}pills.com/de/buy{rng.randint(0, 999)}" for _ in range(80)]
    odd = [None, "", "no scheme", "ftp://", "http://x.ORG", "HTTP://Www.Example.ORG/es/?q#f", "a://b://c.org/x", "http://example.org/en/17",
           "http://notexample.org/en/17", "http://x.com/fr", "u://" + "z" * 20000 + ".org/", "x://É.org/é\n/y", "http://org/"]
    urls += odd * 2 + ["http://m.net/news/77"] * 50 + ["http://ppills.net/de/buy12"]
    pages = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)] + [(None, "http://a.org/", "y", 2)],
                                  "page_id long, url string, host string, ctx int").repartition(3)
    got = filter_urls(pages).collect()
    by = {r.page_id: r for r in got}
    for k, u in enumerate(urls):
        host, path, rule, verdict = judge(u)
        assert (by[k].host, by[k].path, by[k].rule) == (host, path, rule) and verdict in (None, by[k].verdict)
    of = lambda u: by[urls.index(u)].verdict
    assert of("http://m.net/news/77") == "allow" and of("http://ppills.net/de/buy12") == "block"
    assert sorted((tuple(r) for r in got), key=str) == twin(pages.toPandas())
    assert filter_urls(pages.where("page_id > 9999")).collect() == []


def test_without_examples(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert [(r.verdict, r.score) for r in filter_urls(pages).orderBy("page_id").collect()] == [("allow", 0.0)] * 2


def test_ratios_by_brute_force(spark, rng):
    def grams(words):
        return [(p[k:k + ORDER], p[k + ORDER]) for w in words for p in ["\x02" * ORDER + w + "\x03"] for k in range(len(w) + 1)]

    words = ["".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(60)]
    good, bad, new = Counter(grams(words[:20])), Counter(grams(words[20:40])), grams(words[40:])

    def chance(counts, ctx, ch):
        seen = defaultdict(Counter)
        for (c, h), n in counts.items():
            for k in range(ORDER + 1):
                seen[c[len(c) - k:]][h] += n
        p = EVEN_CHANCE
        for k in range(ORDER + 1):
            own = seen.get(ctx[len(ctx) - k:])
            if own:
                p = (own[ch] + len(own) * p) / (sum(own.values()) + len(own))
        return p

    types = sorted({*good, *bad, *new})
    counted = spark.createDataFrame([(c, h, good[c, h], bad[c, h]) for c, h in {*good, *bad}], "ctx string, ch string, n_allow long, n_block long")
    got = gram_ratios(spark.createDataFrame(types, "ctx string, ch string"), counted).collect()
    assert len(got) == len(types)
    for r in got:
        assert math.isclose(r.ratio, math.log(chance(good, r.ctx, r.ch) / chance(bad, r.ctx, r.ch)), abs_tol=1e-9)


def test_whole_urls_count(spark, rng):
    """URLs that part after their path only, in query, fragment or scheme, are judged by that."""
    rows = [f"http://a{k % 7}.org/x?good=fine{rng.randint(0, 99)}" for k in range(60)]
    rows += [f"http://b{k % 7}.com/de/x?buy=pills{rng.randint(0, 99)}#casino" for k in range(60)]
    odd = ["http://c.net/x?good=fine7", "http://c.net/x?buy=pills7#casino", "good=fine8", "buy=pills8#casino"]
    pages = spark.createDataFrame(list(enumerate(rows + odd)), "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    good, bad, plain_good, plain_bad = (got[len(rows) + k] for k in range(4))
    assert (good.host, good.path) == (bad.host, bad.path) and (plain_good.host, plain_good.path) == ("", "")
    assert good.score > bad.score + 1 and plain_good.score > plain_bad.score + 1
    assert bad.verdict == plain_bad.verdict == "block" and bad.rule is None


def test_hot_grams_give_the_same(spark, rng, monkeypatch):
    from tuplespace.llm import urls

    rows = [f"{'http' * 90}://{rng.choice('abc')}.org/{rng.randint(0, 99)}" for _ in range(30)]
    rows += [f"http://{rng.choice('pq')}.com/de/{'buy' * rng.randint(1, 200)}" for _ in range(30)] + ["x" * 1100, None]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    want = twin(pages.toPandas())
    for share in (1, 10, 10**9):
        monkeypatch.setattr(urls, "HOT_SHARE", share)
        assert sorted((tuple(r) for r in filter_urls(pages).collect()), key=str) == want
