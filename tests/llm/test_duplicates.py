"""The Jaccard join against brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from larder.llm import common, jaccard_join
from larder.llm.jaccard_join import block_roots, drop_similar, similar_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def expected(rows):
    """(n_shingles, component_id) of rows (doc_id, text) with distinct ids."""
    sets = {i: shingles(text) for i, text in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 12, 20, 60, 150, 400]))]
        if rng.random() < 0.4:
            base = shared + base
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_block_roots_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(25):
        bases = [np.unique(rng.integers(1, 10**6, rng.integers(1, 120)).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(rng.integers(2, 40)):
            base = bases[rng.integers(4)]
            kept = base[rng.random(len(base)) > rng.random() * 0.12]
            added = rng.integers(1, 10**6, rng.integers(0, len(base) // 10 + 1)).astype(np.uint64)
            sets.append(np.union1d(kept if len(kept) else base, added))
        ids = rng.permutation(len(sets)).astype(np.int64)
        root = list(range(len(sets)))
        for _ in sets:
            for i in range(len(sets)):
                for j in range(len(sets)):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                        root[i] = root[j] = min(root[i], root[j])
        want = [min(ids[j] for j in range(len(sets)) if root[j] == root[i]) for i in range(len(sets))]
        assert block_roots(ids, sets).tolist() == want


@pytest.mark.parametrize("chunk", [jaccard_join.CHUNK_SHINGLES, 300])
def test_components_against_brute_force(spark, monkeypatch, chunk):
    """With blocks whole, and dealt out in chunks."""
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", chunk)
    rows = near_copies(chunk)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(frame).collect()}
    assert got == expected(rows)


def test_odd_rows(spark, messy, nothing):
    rows = similar_components(messy).collect()
    assert len(rows) == messy.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_shingles == by_id[3].n_shingles == 0 and by_id[3].component_id == 3
    assert by_id[9].component_id == 8 and by_id[8].n_shingles == 1
    assert [r.component_id for r in rows if r.doc_id == 4] == [4, 4]
    assert by_id[None].component_id is None
    assert similar_components(nothing).count() == 0
    kept = drop_similar(messy)
    assert kept.columns == messy.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, None, 7, 8], key=str)


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (60, 50), (60, 61)]
    found = {r.node: r.root for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 50, 60: 50, 61: 50, 50: 50}


def linked_at(rows, n, num, den):
    """component_id of rows (doc_id, text) by brute force over ``n``-word shingles."""
    sets = {}
    for i, text in rows:
        words = text.split(" ")
        sets[i] = {tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, min(len(words), 1)))}
    root = dict(zip(sets, sets, strict=True))
    for a in sets:
        for b in sets:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def longer_and_shorter(seed):
    """Texts with copies that have new text appended, the end cut off, or words changed."""
    rng = random.Random(seed)
    texts, line = [], [f"common{i}" for i in range(9)]
    for _ in range(10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([7, 20, 50, 120, 300]))] + line
        texts.append(words)
        for share in (0.05, 0.12, 0.2, 0.26):
            count = round(share * len(words))
            texts.append(words + [f"n{rng.randrange(10**6)}" for _ in range(count)])
            texts.append(words[: len(words) - count])
            changed = list(words)
            for at in rng.sample(range(len(words)), round(share / 6 * len(words))):
                changed[at] = "changed"
            texts.append(changed)
    rng.shuffle(texts)
    return [(i, " ".join(words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize("rule", [(5, 80, 100), (5, 85, 100)])
def test_rules_against_brute_force(spark, rule):
    """By prefixes, and by segments at another threshold than that of op2."""
    rows = longer_and_shorter(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = linked_at(rows, *rule)
    got = {r.doc_id: r.component_id for r in similar_components(frame, jaccard_join.Rule(*rule)).collect()}
    assert got == want
    assert len(set(want.values())) < len(set(linked_at(rows, rule[0], 95, 100).values()))


def test_stage_takes_five_words_and_four_fifths(spark):
    rows = longer_and_shorter(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(linked_at(rows, 5, 80, 100).values())
    assert want != set(linked_at(rows, 3, 90, 100).values())
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()} == want


def test_a_repeated_id_loses_no_other_text(spark):
    """Two texts of one id are told apart; of a component's rows one stays."""
    base = [f"w{i}" for i in range(40)]
    rows = [
        (7, " ".join(base)), (7, "entirely other words that nobody else has here"),
        (3, " ".join([*base, "end"])), (9, "entirely other words that nobody else has here"),
        (9, "a third text of its own, not like any of them"), (9, "a third text of its own, not like any of them"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(r) for r in drop_similar(frame).collect())
    assert kept == sorted({rows[1], rows[2], rows[4]})
    found = sorted((r.doc_id, r.component_id) for r in similar_components(frame).collect())
    assert found == [(3, 3), (7, 3), (7, 7), (9, 7), (9, 9), (9, 9)]


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(chain, most_rounds=1)


def test_rows_alone_stay_beside_ids_of_one_bit(spark):
    """Ids that share a bit with a dropped copy, that repeat, or are negative stay where they are alone."""
    step = jaccard_join.BITS
    copies = [(i, "one text that three rows of this table have in common") for i in (step + 2, 2, -4)]
    lone = [(2 + 2 * step, "a text of its own"), (-4, "the smallest id once more"), (-5, "below zero"), (6, "x")]
    blank = [(2, " \n"), (2, None), (None, "no id at all"), (step + 2, "")]
    frame = spark.createDataFrame([(*r, r[0]) for r in copies + lone + blank], "doc_id long, text string, bits long")
    kept = Counter(tuple(r) for r in drop_similar(frame).collect())
    assert kept == Counter((*r, r[0]) for r in copies[2:] + lone + blank)
    once = frame.where("text = 'below zero'")
    plan = drop_similar(once)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Cartesian" not in plan and drop_similar(once).count() == 1
