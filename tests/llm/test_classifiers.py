"""Quality, toxicity and language: held-out accuracy, plain versions and odd rows."""

import zlib
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa

from larder.llm import language_id, quality_classifier, queries, toxicity
from larder.llm.textarrays import words_of

SF_DIR = "/root/testdata/sf0.01"


def area(score, label):
    """Share of pairs of a positive and a negative that the score orders right."""
    order = np.argsort(np.argsort(score))
    hits, total = label.sum(), len(label)
    return (order[label == 1].sum() - hits * (hits - 1) / 2) / (hits * (total - hits))


def held_out_scores(spark, name, column):
    frame = queries.QUERIES[name](spark, SF_DIR)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = frame.where("held_out").join(labels, "doc_id").where(f"{column} IS NOT NULL").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    return np.array([r.score for r in rows]), np.array([r[column] for r in rows])


def test_quality_on_held_out_documents(spark):
    assert area(*held_out_scores(spark, "op1_quality", "quality")) > 0.9


def test_toxicity_on_held_out_documents(spark):
    score, label = held_out_scores(spark, "op3_toxicity", "toxic")
    assert area(score, label) > 0.9
    assert (score[label == 0] < 0.7).mean() > 0.97


def test_language_on_held_out_documents(spark):
    frame = queries.op8_language(spark, SF_DIR)
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text")
    rows = frame.where("held_out AND lang_pred <> 'und'").join(truth, "doc_id").where("length(text) > 100").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_isotonic_against_minimax():
    """The pooled shares equal the max-min formula of isotonic regression."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, 40).astype(float)
    hits = np.floor(counts * rng.random(40))
    h, n = hits + 0.01 * hits.sum() / counts.sum(), counts + 0.01
    means = lambda i, j: h[i : j + 1].sum() / n[i : j + 1].sum()
    expected = [max(min(means(i, j) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(quality_classifier.isotonic(hits, counts), expected)


def test_statistics_of_a_text():
    text = pa.array(["The cat\nTHE dog 12 #", "", None, "a"])
    rows = np.concatenate([quality_classifier._statistics(w) for w in words_of(text)])
    assert rows.shape == (4, quality_classifier.N_STATISTICS)
    assert np.isclose(rows[0, 0], np.log1p(6)) and np.isclose(rows[0, 3], 5 / 6)
    assert not rows[1].any() and not rows[2].any()
    assert np.isclose(rows[0, 12], np.sqrt(4 / 20))  # capital letters


def test_kneser_ney_against_dictionaries():
    """Word differences equal the formula worked out with dictionaries of contexts."""
    texts = {0: ["a b c a b", "a c", "dddddx b"], 1: ["a z z z", "dddddy z b"]}
    words, stems = [Counter(), Counter()], [Counter(), Counter()]
    for c, group in texts.items():
        pairs = set()
        for text in group:
            tokens = text.split()
            pairs |= set(zip([None, *tokens], tokens, strict=False))
        words[c].update(w for _, w in pairs)
        stems[c].update(w[: toxicity.PREFIX_BYTES] for _, w in pairs)
    array_w = np.zeros((2, toxicity.WORD_BUCKETS), dtype=np.float32)
    array_s = np.zeros((2, toxicity.PREFIX_BUCKETS), dtype=np.float32)
    for c, group in texts.items():
        found = {}
        for chunk in words_of(pa.array(group)):
            whole, stem = toxicity._buckets(chunk)
            for w, s, x in zip(whole, stem, toxicity._contexts(chunk, whole), strict=True):
                found[(w, x)] = s
        for (w, _), s in found.items():
            array_w[c, w] += 1
            array_s[c, s] += 1
    counts = toxicity.Counts.of(array_w, array_s)
    tokens = ["a", "z", "dddddx", "dddddq", "unseen"]
    chunk = next(words_of(pa.array([" ".join(tokens)])))
    whole, stem = toxicity._buckets(chunk)
    got = counts.differences(whole, stem, None, None, None)
    d, total = toxicity.DISCOUNT, [sum(words[c].values()) for c in (0, 1)]
    for token, value in zip(tokens, got, strict=True):
        s = token[: toxicity.PREFIX_BYTES]
        p_word = (words[0][token] + words[1][token] + 0.5) / (sum(total) + 0.5 * toxicity.WORD_BUCKETS)
        p_stem = (stems[0][s] + stems[1][s] + 0.5) / (sum(total) + 0.5 * toxicity.PREFIX_BUCKETS)
        logs = []
        for c in (0, 1):
            r = max(stems[c][s] - d, 0) / total[c] / p_stem + d * len(stems[c]) / total[c]
            logs.append(log(max(words[c][token] - d, 0) / total[c] + d * len(words[c]) / total[c] * p_word * r))
        assert np.isclose(value, logs[1] - logs[0], atol=1e-5)
    assert got[1] > 1 > abs(got[4])


def test_window_and_strongest_words():
    counts = toxicity.Counts.of(
        np.zeros((2, toxicity.WORD_BUCKETS), np.float32), np.zeros((2, toxicity.PREFIX_BUCKETS), np.float32)
    )
    texts = pa.array(["b a a", "", None, "c"])
    rows = np.concatenate([toxicity._features(w, counts, None) for w in words_of(texts)])
    assert rows.shape == (4, toxicity.N_FEATURES) and np.isclose(rows[0, 5], np.log(4)) and not rows[1].any()


def test_odd_rows_score(spark, messy, nothing, marks):
    n = messy.count()
    for labels in (marks, marks.limit(0)):
        scored = toxicity.score_toxicity(messy, toxicity.fit_toxicity(messy, labels), "likely").collect()
        assert len(scored) == n and all(0 <= r.likely <= 1 for r in scored)
        scored = quality_classifier.classify_quality(messy, labels).collect()
        assert len(scored) == n and all(0 <= r.score <= 1 for r in scored)
    assert quality_classifier.classify_quality(nothing, marks).count() == 0
    assert toxicity.drop_toxic(nothing, marks).count() == 0
    kept = toxicity.drop_toxic(messy, marks)
    assert kept.columns == messy.columns


def test_odd_rows_language(spark, messy, nothing):
    plain = messy.select("doc_id", "text", "lang", "source")
    rows = language_id.predict_languages(plain, language_id.fit_languages(plain)).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == messy.count()
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == "und" and by_id[1].score == 0
    assert by_id[5].lang_pred in {"en", "de"} and by_id[7].lang_pred != "und"
    empty = language_id.fit_languages(nothing)
    assert {r.lang_pred for r in language_id.predict_languages(plain, empty).collect()} == {"und"}


def test_a_rare_language_is_learned_however_many_rows_others_have(spark):
    words = {"aa": "alpha gamma delta", "bb": "omicron upsilon sigma", "cc": "zzyzx qwrtp vbnmk"}
    rows = [(i, " ".join([words["aa" if i % 2 else "bb"]] * 3) + f" {i % 7}", "aa" if i % 2 else "bb") for i in range(900)]
    rows += [(5000 + i, words["cc"] + f" {i}", "cc") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(frame, most_rows=100, least_rows=20)
    assert model.languages == ["aa", "bb", "cc"]
    asked = spark.createDataFrame([(1, "zzyzx qwrtp", "x", 1)], "doc_id long, text string, score string, lang_pred int")
    found = language_id.predict_languages(asked, model)
    assert found.columns == ["doc_id", "text", "score", "lang_pred", "lang_pred_", "score_"]
    row = found.first()
    assert (row.score, row.lang_pred, row.lang_pred_) == ("x", 1, "cc")


def language_by_loops(rows, asked, landmarks):
    """Kernel ridge with the same landmarks, kernels counted by sets of hashed n-grams."""
    bits = {text: np.concatenate([b for _, b in language_id.presence(pa.array([text]))])[0] for text in {*rows, *asked}}
    grams = {text: frozenset(np.flatnonzero(b)) for text, b in bits.items()}
    kernel = lambda a, b: len(grams[a] & grams[b]) / max((len(grams[a]) * len(grams[b])) ** 0.5, 1e-30)
    marks = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(marks)
    kept = values > 1e-6 * values.max()
    basis = vectors[:, kept] / np.sqrt(values[kept])
    names = sorted(set(rows.values()))
    z = lambda text: np.concatenate([[1.0], np.array([kernel(text, m) for m in landmarks]) @ basis])
    seen = np.array([z(text) for text in rows])
    truth = np.array([[float(of == name) for name in names] for of in rows.values()])
    damp = np.full(seen.shape[1], language_id.RIDGE * len(seen) / seen.shape[1])
    damp[0] = 1e-6
    solved = np.linalg.solve(seen.T @ seen + np.diag(damp), seen.T @ truth)
    return {text: names[int((z(text) @ solved).argmax())] for text in asked}


def test_language_against_kernels_of_sets(spark):
    rng = np.random.default_rng(8)
    stems = {"aa": ["alp", "ort", "ine"], "bb": ["umb", "oft", "yre"], "cc": ["zza", "ekk", "oon"]}
    make = lambda name: " ".join("".join(rng.choice(stems[name], 2)) for _ in range(6))
    rows = {}
    for i in range(60):
        rows.setdefault(make("abc"[i % 3] * 2), "abc"[i % 3] * 2)
    data = [(i, text, of) for i, (text, of) in enumerate(rows.items())]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    used = {text: of for i, text, of in data if zlib.crc32(str(i).encode()) % 4 != 2}
    model = language_id.fit_languages(frame, landmarks=3 * len(data))
    asked = list(rows)
    want = language_by_loops(used, asked, sorted(used))
    got = dict(zip(asked, model.predict(pa.array(asked))[0], strict=True))
    assert got == want


def test_presence_bits_against_sets():
    texts = ["Abab é", "", "xyz"]
    rows = np.concatenate([bits for _, bits in language_id.presence(pa.array(texts))])
    for text, row in zip(texts, rows, strict=True):
        data = text.replace("A", "a").encode()
        grams = {data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)}
        assert row.sum() == len(grams)


def test_toxicity_counts_every_labelled_text(spark, monkeypatch):
    """Contexts come from texts beyond the bound of the regression, and buckets follow the words."""
    monkeypatch.setattr(toxicity, "WORD_BUCKETS", 16)
    monkeypatch.setattr(toxicity, "PREFIX_BUCKETS", 16)
    texts = [(i, f"word{i} plain{i} text{i} {'vile' if i % 2 else 'mild'}{i}", i % 2) for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), most_rows=60)
    counts = model.counts.value
    used = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 3 != 1]
    assert counts.words.sum() == 4 * len(used) and counts.words.shape[1] >= 8 * len(used)
    for i in used:
        chunk = next(words_of(pa.array([f"vile{i}" if i % 2 else f"mild{i}"])))
        bucket, _ = toxicity._buckets(chunk, counts.words.shape[1], counts.prefixes.shape[1])
        assert counts.words[i % 2, bucket[0]] >= 1
