"""Archives: exact round trip. Neighbours: recall against brute force."""

import gzip
import hashlib
from pathlib import Path

import numpy as np

from larder.llm import neighbours, warc

SF_DIR = "/root/testdata/sf0.001"
BIG = "<p>" + "é" * 700


def test_archives_round_trip(spark):
    rows = [
        (1, "http://a/", BIG, "x"),
        (2, "http://b/ ü\r\nX: y", BIG, "x"),
        (5, None, BIG, "x"),
        (3, "http://c/", None, None),
        (4, "http://d/", "", "x"),
        (6, "http://e/", "short", "x"),
        (7, "http://e/", "short", "x"),
        (8, "http://f/", "line\r\n\r\nline\n" * 200, "x"),
        (None, "http://g/", BIG, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    folder = warc.archive_folder(pages)
    manifest = warc.write_archives(pages, folder, shard_bytes=2000, roll_bytes=500)
    found = {r.page_id: r for r in warc.read_archives(manifest, folder).collect()}
    assert len(found) == len(rows) and manifest.count() > 2
    for page_id, _, html, _ in rows:
        payload, r = (html or "").encode(), found[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    assert {i: r.refers_to for i, r in found.items() if r.record_type == "revisit"} == {1: 5, 2: 5}


def test_archives_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    files = []
    for frame in (pages.repartition(3), pages.coalesce(1)):
        folder = warc.archive_folder(pages)
        warc.write_archives(frame, folder, shard_bytes=100_000, roll_bytes=30_000)
        here = Path(folder.removeprefix("file:"))
        files.append({p.name: p.read_bytes() for p in here.glob("*.warc.gz")})
        assert not list(here.glob(".shard*.gz.*"))
    assert files[0] == files[1] and len(files[0]) > 3
    head = gzip.decompress(next(iter(files[0].values())))
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_no_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(0)
    folder = warc.archive_folder(pages)
    assert warc.read_archives(warc.write_archives(pages, folder), folder).count() == 0


def brute_force(rows, modulus, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if len(v) == 16 and np.isfinite(v).all() and v.any()]
    out = {}
    for q, v in good:
        if q % modulus == 0:
            near = sorted((-float(np.einsum("j,j->", v, w)), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    """Over several shards and query blocks, with odd vectors and many equal ones."""
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 256)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.5, 2)).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[3][1]) for i in range(600)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [None] * 16), (5080, [1.0] * 3)]
    rows += [(None, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, 20, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute_force(rows, 20, 10)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.95
    for q in got:
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(frame, 20, 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in rows] == [(0, 1, 1.0), (0, 20, 0.5), (20, 1, 1.0), (20, 0, 0.5)]
    assert neighbours.nearest(frame.limit(0), 20, 20).count() == 0


def test_chi_square_quantile():
    draws = (np.random.default_rng(0).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws <= neighbours.chi_square_quantile(0.95, 8)).mean() - 0.95) < 0.003
