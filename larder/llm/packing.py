"""Packing documents into training sequences by fitted length patterns.

Only the histogram of lengths, at most one number a length, reaches the driver. There,
patterns of two to four lengths that fill a sequence are enumerated, non-negative least
squares fits how often each should repeat so that together they use up the histogram, the
repeats are rounded down, and what remains is packed by best fit, large lengths first, into
the gaps. The result is a list of runs: the pieces of one length, numbered, go to the
sequences of one pattern at one offset. Pieces are numbered and placed on the executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import stage

CAPACITY = 2048
END = 0
SLACK = 4
MOST_PATTERNS = 60_000
STEPS = 150
LONG_BLANK = 100_000


class _Encoder:
    """The ids of texts under a byte-level BPE file of the tokenizers library.

    tiktoken runs the same vocabulary several times faster. It is used while it agrees with
    tokenizers on the first texts of every batch, and not for texts that hold the string of
    a special token, which tokenizers takes for that token, or a run of ``LONG_BLANK`` blanks:
    tiktoken's stack overflows on a million of them.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shifted = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in self.special
        }
        # Fixed value: the pattern that byte-level tokenizers split texts by.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.agrees = True

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for i, text in enumerate(texts):
            special = any(token in text for token in self.special)
            if not self.agrees or special or _long_blank(text):
                yield self.slow.encode(text, add_special_tokens=False).ids
                continue
            ids = self.quick.encode_ordinary(text)
            if i < 1:
                true = self.slow.encode(text, add_special_tokens=False).ids
                self.agrees = ids == true
                ids = true
            yield ids


def _long_blank(text: str) -> bool:
    """Whether a text has a run of ``LONG_BLANK`` blanks; each run is read once."""
    if len(text) < LONG_BLANK:
        return False
    return any(m.end() - m.start() >= LONG_BLANK for m in re.finditer(r"\s+", text))


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the first one takes the rest."""
    first = length % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, length, capacity))]


def tokenize(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document's pieces, stored once.

    A text's ids are followed by one end id; null counts as empty. Only documents longer than
    ``capacity`` are cut. ``ids`` are little-endian unsigned 32-bit numbers. ``path`` is the
    tokenizer's file, which every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [text or "" for text in part.column(1).to_pylist()]
                rows, out = [], ([], [], [], [])
                for i, ids in enumerate(encoder.encode(texts)):
                    ids.append(END)
                    data = np.array(ids, dtype="<u4").tobytes()
                    for number, (start, length) in enumerate(cuts(len(ids), capacity)):
                        rows.append(i)
                        values = (number, start, length, data[4 * start : 4 * (start + length)])
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                ids_of = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids_of, *columns], names=["doc_id", "piece", "start", "length", "ids"]
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary"
    return stage(documents.select("doc_id", "text").mapInArrow(run, schema), "pieces", "zstd")


def _patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to four lengths (0: unused) that leave at most ``SLACK`` free.

    For each largest length: every second length that fills up with a present third, and
    fourth lengths by halving what two leave. Thinned evenly to ``MOST_PATTERNS``.
    """
    present = np.zeros(capacity + 1, dtype=bool)
    present[lengths] = True
    below = np.maximum.accumulate(np.where(present, np.arange(capacity + 1), 0))
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    keep = (b <= a) & (a + b <= capacity)
    a, b = a[keep], b[keep]
    rest = capacity - a - b
    found = []
    pair = rest <= SLACK
    zero = np.zeros(pair.sum(), dtype=int)
    found.append(np.stack([a[pair], b[pair], zero, zero], axis=1))
    c = np.minimum(below[rest], b)
    third = (c > 0) & (rest - c <= SLACK)
    found.append(np.stack([a, b, c, np.zeros_like(c)], axis=1)[third])
    c = np.minimum(below[rest // 2], b)
    d = np.minimum(below[rest - c], c)
    fourth = (c > 0) & (d > 0) & (rest - c - d <= SLACK)
    found.append(np.stack([a, b, c, d], axis=1)[fourth])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:: max(1, ceil(len(rows) / MOST_PATTERNS))]


def _repeats(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative least squares by multiplicative steps: how often each pattern repeats."""
    x = np.ones(len(patterns))
    aimed = np.where(patterns > 0, counts[patterns], 0).sum(axis=1)
    for _ in range(STEPS):
        used = np.bincount(patterns.ravel(), np.repeat(x, 4), minlength=len(counts))
        used[0] = 0
        x *= aimed / np.maximum(used[patterns].sum(axis=1), 1e-12)
    return x


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(how often, lengths) of all sequences for ``counts[length]`` pieces of each length."""
    left = counts.astype(np.int64).copy()
    gaps: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    if left[capacity]:
        gaps[0].append((int(left[capacity]), [capacity]))
        left[capacity] = 0
    lengths = np.flatnonzero(left)
    if len(lengths):
        patterns = _patterns(lengths, capacity)
        if len(patterns):
            repeats = np.floor(_repeats(patterns, left) + 1e-9).astype(np.int64)
            for at in np.argsort(-repeats, kind="stable"):
                if repeats[at] < 1:
                    break
                parts = [int(x) for x in patterns[at] if x]
                often = int(min(repeats[at], *(left[x] // parts.count(x) for x in parts)))
                if often > 0:
                    for x in parts:
                        left[x] -= often
                    gaps[capacity - sum(parts)].append((often, parts))
    for length in range(capacity, 0, -1):
        count = int(left[length])
        gap = length
        while count and gap <= capacity:
            if not gaps[gap]:
                gap += 1
                continue
            often, parts = gaps[gap].pop()
            moved = min(often, count)
            if often > moved:
                gaps[gap].append((often - moved, parts))
            gaps[gap - length].append((moved, [*parts, length]))
            count -= moved
            gap = max(length, gap - length) if gap - length >= length else gap
        each = capacity // length
        if count >= each:
            gaps[capacity - each * length].append((count // each, [length] * each))
        if count % each:
            gaps[capacity - count % each * length].append((1, [length] * (count % each)))
    return [group for groups in gaps for group in groups]


@dataclass(frozen=True)
class Runs:
    """Where the pieces of a length go: numbers from ``low`` on to sequences from ``base`` on."""

    first: np.ndarray  # of each length, its first run
    low: np.ndarray
    base: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, groups: list[tuple[int, list[int]]], capacity: int) -> Runs:
        rows, base = [], 0
        for often, parts in groups:
            offset = 0
            for length in parts:
                rows.append((length, base, offset, often))
                offset += length
            base += often
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        sums = np.concatenate([[0], np.cumsum(table[:, 3])])
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        low = sums[:-1] - sums[first[table[:, 0]]] if len(table) else sums[:0]
        return cls(first, low, table[:, 1], table[:, 2])

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = np.int64(1) << 44
        key = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * span + self.low
        at = np.searchsorted(key, length * span + number, side="right") - 1
        return self.base[at] + number - self.low[at], self.offset[at]


def place(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    ``pieces`` is read twice and should be a stored table. Pieces of a length are numbered
    within buckets by hash of ``order``, laid end to end, so no length meets in one task.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    runs = Runs.of(pack_histogram(counts, capacity), capacity)
    buckets = max(1, ceil(int(counts.max()) / 50_000))
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from")
    )
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = bucketed.withColumn("number", F.row_number().over(inside) - 1)
    numbered = ranked.join(starts, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    kept = [*pieces.columns]
    rows = numbered.select(*kept, (F.col("number") + F.col("from")).alias("number"))
    shipped = pieces.sparkSession.sparkContext.broadcast(runs)
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    at = kept.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(at).to_numpy(), batch.column(len(kept)).to_numpy()
            sequence, offset = shipped.value.place(length, number) if len(length) else (length, length)
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def packed_sequences(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences, ids in order as in ``tokenize``."""
    placed = place(pieces, ["doc_id", "piece"], capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` pieces
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def packed_digests(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces."""
    pieces = tokenize(documents, path, capacity)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return place(digests, ["doc_id", "piece"], capacity)
