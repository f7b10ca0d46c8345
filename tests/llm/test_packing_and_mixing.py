"""Packing and mixing: round trips, plain versions and odd rows."""

from math import ceil

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larder.llm import mixing, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"


def test_packed_sequences_hold_every_document(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tokenizer = Tokenizer.from_file(PATH)
    want = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in documents.collect()}
    pieces = packing.tokenize(documents, PATH)
    placed = packing.place(pieces, ["doc_id", "piece"]).collect()
    ids = lambda r: np.frombuffer(r.ids, "<u4").tolist()
    by_doc, by_sequence = {}, {}
    for r in sorted(placed, key=lambda r: (r.doc_id, r.piece)):
        assert len(ids(r)) == r.length and r.start == len(by_doc.setdefault(r.doc_id, []))
        by_doc[r.doc_id] += ids(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc == want
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, want.values()))
    assert len(by_sequence) <= ceil(total / 2048) * 1.02 + 1
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.packed_sequences(pieces).collect()}
    assert sum(map(len, whole.values())) == total and max(map(len, whole.values())) <= 2048


def test_odd_documents_are_packed(spark, messy, nothing):
    rows = packing.packed_digests(messy, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert sum(r.length for r in rows) == sum(
        len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in messy.collect()
    )
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.packed_digests(nothing, PATH).count() == 0


def test_long_runs_of_blanks_are_packed(spark):
    texts = ["a", "b" + " " * 1_001_000 + "c", "\n" * 1_001_000, "d \u2003\t" * 30_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {}
    for r in packing.packed_digests(frame, PATH).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    tokenizer = Tokenizer.from_file(PATH)
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert got == want


def test_ids_are_those_of_the_tokenizer():
    rng = np.random.default_rng(0)
    texts = ["<|endoftext|> a", "it's  we'll\u00a0x\u2003y\r\n\n z", "don’t 12½ Ⅷ ² 日本語 a\u0301"]
    texts += ["".join(chr(c) for c in rng.integers(1, 0x2FFF, 60)) for _ in range(150)]
    texts += ["".join(chr(c) for c in rng.choice([9, 10, 32, 39, 65, 233, 0x85, 0xA0, 0x1F600], 40)) for _ in range(80)]
    encoder, tokenizer = packing._Encoder(PATH), Tokenizer.from_file(PATH)
    for text in texts:
        text = text.encode("utf-8", "ignore").decode()
        encoder_ids = list(encoder.encode(["a", text]))[1]
        assert encoder_ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("seed", range(4))
def test_histogram_is_packed_whole(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(257, dtype=np.int64)
    np.add.at(counts, np.minimum(rng.geometric(0.01 * (seed + 1), 4000), 256), 1)
    groups = packing.pack_histogram(counts, 256)
    used = np.zeros(257, dtype=np.int64)
    for often, parts in groups:
        assert often > 0 and sum(parts) <= 256
        np.add.at(used, parts, often)
    assert (used == counts).all()
    least = ceil((counts * np.arange(257)).sum() / 256)
    assert sum(often for often, _ in groups) <= least * 1.01 + 2


def reshared(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixture_meets_its_targets(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    again = mixing.mix(documents.repartition(7)).collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}
    sizes, taken, largest, target = {}, {}, {}, {}
    for r in rows:
        assert 0 <= r.copies <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        target[r.source] = r.target
    want = reshared(sizes)
    for s in sizes:
        assert np.isclose(target[s], want[s]), s
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s


def test_rates_solve_the_dual(spark):
    """The multipliers meet the constraints before rounding."""
    rows = [(i, "a" if i % 3 else "b", 10 + i * i % 97) for i in range(300)] + [(999, "c", 5)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    histogram = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    solved = {r.source: r for r in mixing._solve(histogram, mixing.source_targets(histogram)).collect()}
    for source, plan in solved.items():
        if plan.slope is None:
            assert plan.target >= 2 * plan.source_size * 0.999
            continue
        z = np.array([s for _, of, s in rows if of == source], dtype=float)
        rate = 2 / (1 + np.exp(-(np.log(3) + plan.slope * z / plan.mean)))
        assert np.isclose((rate * z).sum(), plan.target, rtol=1e-5)


def test_odd_documents_are_mixed(spark, messy, nothing):
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count() and all(0 <= r.copies <= 2 for r in rows)
    assert mixing.mix(nothing).count() == 0
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns
    assert mixed.where("text IS NULL OR text = ''").count() == 2
    assert mixing.mixed_documents(nothing).count() == 0
    assert mixing.mix(messy.where("text IS NULL")).collect()[0].target == 0
