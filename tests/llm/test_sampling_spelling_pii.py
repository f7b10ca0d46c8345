"""Importance resampling, spelling variants and personal data against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import importance, pii, queries, spelling

SF_DIR = "/root/testdata/sf0.001"


def runs(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


def resampled(rows, target, rule):
    """(n_features, weight, score, rank) by row number, one feature at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % rule.buckets
    corpus = Counter(bucket(f) for _, text in rows for f in runs(text, rule.n)[0])
    wanted = Counter(bucket(f) for text in target for f in runs(text, rule.n)[0])
    size, all_wanted = corpus.total(), wanted.total()
    out, able = {}, []
    for i, (doc_id, text) in enumerate(rows):
        found, words = runs(text, rule.n)
        weight = sum(
            math.floor(
                1000
                * math.log(
                    (wanted[b] + 1) * (size + rule.buckets) / ((corpus[b] + 1) * (all_wanted + rule.buckets))
                )
            )
            for b in map(bucket, found)
        )
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{rule.seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= rule.least_words:
                able.append((-score, doc_id, -len(found), i))
        out[i] = [doc_id, len(found), weight, score, None]
    for rank, (*_, i) in enumerate(sorted(able)[: len(able) * rule.percent // 100], 1):
        out[i][4] = rank
    return sorted(map(tuple, out.values()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling_against_plain(spark, monkeypatch, n):
    """Runs of several words too, with blocks that end inside documents."""
    monkeypatch.setattr(importance, "WORDS_AT_ONCE", 7)
    rng = random.Random(n)
    vocabulary = ["alpha", "Beta", "ÉCOLE", "日本", "x1", "don't", "a-b", "été", "Z"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 30, 60])))) for i in range(90)]
    rows += [(3, "Alpha beta " * 20), (3, "Alpha beta " * 20), (None, "alpha " * 30), (95, None), (96, "\x00 .,")]
    target = ["beta x1 x1 alpha", None, "", "日本 beta"]
    rule = importance.Sampling(n=n, buckets=50, least_words=20, percent=30)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, score string")
    got = importance.resample(frame, wanted, rule).collect()
    assert sorted(map(tuple, got), key=str) == resampled(rows, target, rule)
    assert sum(r.rank is not None for r in got) > 5


def test_features_stay_in_their_document():
    found = list(importance.features([b"a b", b"", b"c", b"d e f"], 2))
    pairs = [owner.tolist() for length, owner, _ in found if length == 2]
    assert pairs == [[0, 3, 3]]


def test_resampling_odd_rows(spark, messy, nothing):
    rows = importance.resample(messy, nothing).collect()
    assert len(rows) == messy.count()
    assert {r.weight for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert [(r.score, r.rank) for r in rows if r.doc_id is None] == [(None, None)]
    assert importance.resample(nothing, messy).count() == 0


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows, rule):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % rule.slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= rule.least_length and k >= rule.least_n}
    form, out = {}, set()
    others = {w: [x for x in n if near(w, x)] for w in n}
    for word, found in others.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[word] = best if best and n[best] >= rule.factor * n[word] else None
    for word, first in form.items():
        root = word
        while form[root]:
            root = form[root]
        out.add((word, first, root, n[word], len(others[word]), n[first] if first else None))
    return out


@pytest.mark.parametrize("most_blocks", [spelling.MOST_BLOCKS, 3])
def test_spelling_against_plain(spark, monkeypatch, most_blocks):
    """With one filter, and with a filter for each slice of the vocabulary."""
    monkeypatch.setattr(spelling, "MOST_BLOCKS", most_blocks)
    monkeypatch.setattr(spelling, "PLACES_AT_ONCE", 5)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (most_blocks,))
    rng = random.Random(7)
    words = ["éclairage", "montages", "ÿÿÿÿÿÿ", "aaaaaa", "aaaaaaa", "committee", "x" * 70, "x" * 69 + "y", "x" * 71]
    rows = []
    for i in range(60):
        text = []
        for _ in range(40):
            word = rng.choice(words[: 3 + i % 7])
            while rng.random() < 0.25:
                at = rng.randrange(len(word))
                word = word[:at] + rng.choice(["", word[at] * 2, rng.choice("abÀÿ")]) + word[at + 1 :]
            text.append(rng.choice([word, word.title(), word.upper()]))
        rows.append((i, "; ".join(text)))
    rows += [(None, "committee " * 9), (70, None), (71, "")]
    rule = spelling.Spelling(slip=5, factor=2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spelling.variants(frame, rule).collect()
    want = spelled(rows, rule)
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want
    assert any(row[1] and row[2] != row[1] for row in want)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(6, 12))) for _ in range(4000)]
    flat = spelling.Flat(words)
    shards = spelling.Shards.of(Counter(map(len, words)), spelling.MOST_BLOCKS)
    _, block, bits = shards.place(flat.keys(), flat.lengths)
    filled = np.zeros(int(shards.blocks.sum()), dtype=np.uint64)
    np.bitwise_or.at(filled, block, bits)
    assert ((filled[block] & bits) == bits).all()
    others = spelling.Flat([w[:-1] + "z" for w in words])
    _, block, bits = shards.place(others.keys(), others.lengths)
    assert ((filled[block] & bits) == bits).mean() < 0.05
    assert len(filled) <= len(words) / spelling.KEYS_A_BLOCK + 7  # 16 bits a word


def test_spelling_odd_rows(spark, messy, nothing):
    rule = spelling.Spelling(least_length=3, least_n=2)
    words = {r.word: r.n for r in spelling.variants(messy, rule).collect()}
    assert words["kleiner"] == 2 and words["words"] == 2
    assert spelling.variants(nothing).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(messy, spelling.Spelling(factor=1))


def plain_spans(text):
    """The contract's patterns as they stand."""
    found = []
    for turn, (kind, pattern) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ]
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd, even = digits[-1::-2], digits[-2::-2]
            luhn = sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)
            if (
                kind == "email"
                or (kind == "ip" and all(int(part) <= 255 for part in m[0].split(".")))
                or (kind == "card" and 12 <= len(digits) <= 19 and luhn % 10 == 0)
                or (kind == "phone" and 9 <= len(digits) <= 15)
            ):
                found.append((m.start(), turn, m.end()))
    return sorted(found)


def test_base_spans_against_the_patterns():
    rng = random.Random(2)
    pieces = ["a.b", "@", "x", ".", "-", "_", "1", "12", "255", "256", "0005", " ", "+1", "(", ")", "é", "\U0001f600",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (509) 555-6973", "10.0.0.1", "me@ex.org", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), repr(text)
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000 + "." * 9) == []
    assert pii.base_spans("1." * 20_000) == plain_spans("1." * 20_000)


def plain_terms(texts, rule):
    """term -> share, with whole tables in memory."""
    near, apart, count, total = Counter(), defaultdict(Counter), Counter(), 0
    for text in texts:
        text = text or ""
        spans = plain_spans(text)
        terms = [
            (m.start(), m[0].lower())
            for m in re.finditer(r"[^\W_]+", text)
            if not any(a < m.end() and m.start() < b for a, _, b in spans)
        ]
        total += len(terms)
        count.update(t for _, t in terms)
        done = set()
        for a, kind, b in spans:
            who = pii.entity(kind, text[a:b])
            left = [i for i, (at, _) in enumerate(terms) if at < a][-rule.window :]
            right = [i for i, (at, _) in enumerate(terms) if at >= b][: rule.window]
            hashes = {terms[i][1]: zlib.crc32(terms[i][1].encode()) for i in left + right}
            for i in left + right:
                if (who, i) not in done:
                    done.add((who, i))
                    term = terms[i][1]
                    context = min((h for h in hashes.values() if h != hashes[term]), default=hashes[term])
                    near[who, term] += 1
                    apart[who, term][context] += 1
    whole = Counter()
    for (who, _), n in near.items():
        whole[who] += n
    shares = {}
    for (who, term), n in near.items():
        entropy = -sum(k / n * math.log2(k / n) for k in apart[who, term].values())
        if 2**entropy >= rule.least_contexts - 1e-9:
            pmi = math.log2(n / total / (whole[who] / total * count[term] / total))
            share = pmi / -math.log2(whole[who] / total)
            if share >= rule.generalise:
                shares[term] = max(share, shares.get(term, 0))
    return shares


def private_texts():
    rng = random.Random(5)
    filler = [f"w{i}x" for i in range(300)] + ["the", "of", "wrote", "server"] * 20
    some = lambda k: " ".join(rng.choices(filler, k=k))
    texts = []
    for i in range(40):
        texts.append(f"{some(20)} Zebulon Quist wrote zq@mail.example.org {some(20)}")
        texts.append(f"{some(15)} the server 10.1.2.3 of Marbury {some(12)}")
        texts.append(f"{some(30)} the end {some(9)}")
        texts.append(f"{some(3)} Marbury {some(9)}" if i % 2 else None)
        texts.append(f"{some(25)} Zebulon again" if i % 4 == 0 else some(9))
    copied = f"{some(20)} uniqueterm solo@mail.example.org {some(20)}"
    return texts + [copied] * 50 + [copied.replace("w1", "v1", 1), ""]


def test_terms_against_plain(spark):
    texts = private_texts()
    rule = pii.Disclosure()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    want = plain_terms(texts, rule)
    got = {r.term: r for r in pii.disclosing_terms(frame, rule).collect()}
    assert {t: round(r.share, 9) for t, r in got.items()} == {t: round(s, 9) for t, s in want.items()}
    assert got["quist"].action == pii.REMOVE and got["zebulon"].action == pii.GENERAL and "the" not in got
    assert "uniqueterm" not in got  # fifty copies are one context
    spans = {r.doc_id: r.spans for r in pii.find(frame, rule).collect()}
    for i, text in enumerate(texts):
        base = plain_spans(text)
        added = [
            (m.start(), 4, m.end())
            for m in re.finditer(r"[^\W_]+", text or "")
            if m[0].lower() in got and not any(a < m.end() and m.start() < b for a, _, b in base)
        ]
        assert [(s.start, s.turn, s.end) for s in spans[i]] == sorted(base + added)
    cleaned = {r.doc_id: r.text for r in pii.sanitise(frame, rule).collect()}
    assert cleaned[3] is None and len(cleaned) == len(texts)
    assert all("Quist" not in (t or "") and "zq@" not in (t or "") for t in cleaned.values())
    assert "[NAME]  wrote [EMAIL]" in cleaned[0] and cleaned[2] == texts[2]


def test_query_pii(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op13_pii(spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for row in rows:
        spans = plain_spans(row.text)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        found = got[row.doc_id]
        assert found.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (found.n_email, found.n_ip, found.n_card, found.n_phone) == tuple(
            sum(k == kind for _, k, _ in spans) for kind in range(4)
        )
        assert set(text.split(",")) <= set(found.spans.split(","))


def test_pii_odd_rows(spark, messy, nothing):
    found = pii.find(messy)
    assert found.columns == ["doc_id", "base", "spans"] and found.count() == messy.count()
    assert all(r.spans == [] for r in found.collect())
    assert pii.find(nothing).count() == 0
    clean = pii.sanitise(messy)
    assert clean.columns == messy.columns
    assert sorted(clean.collect(), key=str) == sorted(messy.collect(), key=str)
