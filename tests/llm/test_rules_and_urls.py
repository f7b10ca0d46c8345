"""Host rules and URL filters against plain Python, and odd rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from larder.llm import host_rules, url_filter


def test_odd_documents(spark, messy, nothing):
    rows = host_rules.judge(messy, ["doc_id", "source"]).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == messy.count()
    assert (by_id[1].n_words, by_id[1].base_failed, by_id[1].kept) == (0, True, False)
    assert by_id[4].n_words == 20_000 and by_id[4].n_repeat_words == 20_000
    assert (by_id[5].n_dup_lines, by_id[5].n_words, by_id[5].n_repeat_words) == (1, 6, 6)
    assert (by_id[7].n_symbols, by_id[7].word_chars) == (6, 9)
    assert host_rules.judge(nothing, ["doc_id", "source"]).count() == 0
    assert host_rules.drop_rejected(messy).columns == messy.columns
    assert host_rules.drop_rejected(nothing).count() == 0


def test_hosts_with_failures_are_shrunk(spark):
    """A host that mostly fails is rejected whole, one bad document doesn't condemn a small host."""
    good = " ".join(f"w{i}" for i in range(80))
    bad = good + " ####" * 60
    rows = [(i, good, "fine") for i in range(200)]
    rows += [(1000 + i, bad if i % 10 else good, "poor") for i in range(100)]
    rows += [(2000, bad, "small"), (2001, good, "small")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_rules.judge(frame, ["doc_id", "source"]).where("kept").collect()}
    assert kept == {*range(200), 2001} or kept == set(range(200))
    verdicts = {r.source: r.host_verdict for r in host_rules.judge(frame, ["doc_id", "source"]).collect()}
    assert verdicts["poor"] == "reject" and verdicts["fine"] == "trust"


URLS = [f"http://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate(
    [("ab", "org", "en"), ("cd", "com", "de"), ("ef", "com", "fr"), ("ab", "net", "de"), ("x", "net", "fr")] * 6)]


def plain_scores(examples, urls):
    """The log ratio a character, straight from the recursion."""
    pad, order = url_filter.PAD, url_filter.ORDER
    counts = {v: Counter() for v in ("allow", "block")}
    for url, verdict in examples:
        text = pad * (order - 1) + url + pad
        for i in range(order - 1, len(text)):
            for n in range(order):
                counts[verdict][text[i - n : i + 1]] += 1
    sums = {v: Counter() for v in counts}
    for v in counts:
        for gram, n in counts[v].items():
            sums[v][(len(gram), gram[:-1])] += n
    kinds = len({g for v in counts for g in counts[v] if len(g) == 1})

    def p(v, gram):
        below = 1 / kinds if len(gram) == 1 else p(v, gram[1:])
        at = (len(gram), gram[:-1])
        if sum(sums[u][at] for u in sums) < url_filter.LEAST:
            return below
        return (counts[v][gram] + url_filter.KAPPA * below) / (sums[v][at] + url_filter.KAPPA)

    out = {}
    for url in urls:
        text = pad * (order - 1) + url + pad
        grams = [text[i - order + 1 : i + 1] for i in range(order - 1, len(text))]
        out[url] = sum(math.log(p("allow", g) / p("block", g)) for g in grams) / max(len(url), 1)
    return out


def test_url_scores_against_recursion(spark):
    """Weights add up to the recursion's score; the query's scores add them up by bucket."""
    urls = [*URLS, "zz"]
    allowed = lambda url: ".org/" in url and "/en/1" not in url or "com/fr/" in url
    examples = [(u, "allow" if allowed(u) else "block") for u in URLS if ".org/" in u or ".com/" in u]
    want = plain_scores(examples, urls)
    table = url_filter.fit_weights(spark.createDataFrame(examples, "url string, verdict string"))
    weight = {r.key: r.weight for r in table.collect()}
    order, keys = url_filter.ORDER, {}
    for url in urls:
        text = url_filter.PAD * (order - 1) + url + url_filter.PAD
        at = [(text[i - n : i + 1], text[i - n : i] + url_filter.ANY) for i in range(order - 1, len(text)) for n in range(order)]
        keys[url] = [key for pair in at for key in pair]
    every = sorted({key for found in keys.values() for key in found} | weight.keys())
    buckets = spark.createDataFrame([(k,) for k in every], "key string").select("key", url_filter._bucket(F.col("key")).alias("b"))
    bucket, shared = {r.key: r.b for r in buckets.collect()}, Counter()
    for key, value in weight.items():
        shared[bucket[key]] += value
    exact = {url: sum(weight.get(k, 0) for k in found) / max(len(url), 1) for url, found in keys.items()}
    hashed = {url: sum(shared[bucket[k]] for k in found) / max(len(url), 1) for url, found in keys.items()}
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_filter.judge(frame).collect()
    for r in rows:
        assert math.isclose(exact[urls[r.page_id]], want[urls[r.page_id]], abs_tol=1e-9)
        assert math.isclose(r.score, hashed[urls[r.page_id]], abs_tol=1e-4)
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[3] == "block" and verdict[4] == "allow"  # net: as the paths of the examples


def test_url_scores_do_not_depend_on_slots(spark, monkeypatch):
    """No gram takes over the weight of another, seen or not."""
    monkeypatch.setattr(url_filter, "BUCKETS", 64, raising=False)
    urls = [f"https://a{i}.example.org/{'en/2' if i % 2 else 'es/'}{i * i}/slug-{i}" for i in range(40)]
    urls += [f"http://b{i}.net/qqq/{i}" for i in range(5)]
    examples = [(u, "block" if "/es/" in u else "allow") for u in urls[:40]]
    want = plain_scores(examples, urls)
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(frame).collect():
        assert math.isclose(r.score, want[urls[r.page_id]], abs_tol=1e-9)


def test_rules(spark):
    urls = {
        "https://EXAMPLE.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://a.example.org/en/12?x": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "x://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://org/?q=://com/de/": ("org", "/", "org/", "allow"),
        "x://b.com/de/#://": ("b.com", "/de/", "com/de/", "block"),
        "no host": ("", "", None, None),
        "x://org": ("org", "", None, None),
        None: ("", "", None, None),
    }
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(frame).collect():
        host, path, rule, verdict = list(urls.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict is None and r.verdict in {"allow", "block"} or r.verdict == verdict
    assert url_filter.judge(frame.limit(0)).count() == 0
