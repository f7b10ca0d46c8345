"""Importance resampling towards a target, by features of concatenated batches.

Features are hashed word runs of up to ``n`` words. The texts of a batch are joined with a
separator no word holds, and one pass of a regular expression over the joined bytes finds
all words; where a word starts tells its document by binary search in the documents'
offsets, and a run whose first and last word differ in document is masked out before the
buckets are counted. Words are bytes throughout: UTF-8 sequences have no byte under 0x80,
so a class of bytes is the contract's class of code points.

The gain of a bucket is the log ratio of its smoothed share in the target and in the
corpus; a document's weight is the sum over its features. Adding Gumbel noise drawn from
its id and taking the highest scores samples without replacement in proportion to the
exponential of the weight.

Passes: one counts the corpus (a row per task and bucket, at most ``buckets`` a task), one
weighs it with the gains, an array of ``buckets`` numbers. Ranks come from a range sort of
narrow rows, numbered inside their partition and shifted by the sizes of those before.

Defined results: a null or empty text has no features and weight 0. A row without doc_id
has no noise: its score and rank are null, and it is not among the N. Repeated rows are
rows of their own; of rows with equal score and doc_id the one with more features comes
first. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import stage
from larder.llm.textarrays import chunks

#: Lower-cased words: anything but ASCII that is no letter or digit.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\x00"
WORDS_AT_ONCE = 1 << 16


@dataclass(frozen=True)
class Sampling:
    """Runs of up to ``n`` words in ``buckets``; ``percent`` of the documents of ``least_words`` are drawn."""

    n: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def features(texts: list[bytes], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a run, text of each run, crc32 of each run), some words at a time."""
    joined = SEPARATOR.join(texts).lower()
    offsets = np.cumsum([0, *(len(text) + 1 for text in texts[:-1])])
    found = WORD.finditer(joined)
    words: list[bytes] = []
    places = np.zeros(0, dtype=np.int64)
    while block := list(islice(found, WORDS_AT_ONCE)):
        kept = min(n - 1, len(words))  # the last words of the block before begin runs too
        words = words[len(words) - kept :] + [match.group() for match in block]
        starts = np.fromiter((match.start() for match in block), np.int64, len(block))
        places = np.concatenate([places[len(places) - kept :], starts])
        owner = np.searchsorted(offsets, places, side="right") - 1
        spaced = [b" " + word for word in words] if n > 1 else []
        sums = list(map(crc32, words))
        for length in range(1, n + 1):
            if length > 1:
                sums = list(map(crc32, spaced[length - 1 :], sums))
            first, last = owner[: len(sums)], owner[length - 1 :]
            whole = (first == last) & (np.arange(len(sums)) + length > kept)
            yield length, first[whole], np.array(sums, dtype=np.int64)[whole]


def _texts(column: pa.Array) -> Iterator[tuple[range, list[bytes]]]:
    """Some megabytes of texts at a time, as bytes."""
    for rows, data, bounds in chunks(column):
        raw = data.tobytes()
        yield rows, [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def bucket_counts(texts: DataFrame, rule: Sampling) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(rule.buckets, dtype=np.int64)
        for batch in batches:
            for _, part in _texts(batch.column(0)):
                for _, _, sums in features(part, rule.n):
                    counts += np.bincount(sums % rule.buckets, minlength=rule.buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(rule.buckets, dtype=np.int64)
    for row in rows.collect():  # a row for each bucket at most
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    size, wanted, buckets = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (size + buckets) / ((s + 1.0) * (wanted + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def weigh(documents: DataFrame, gain: np.ndarray, rule: Sampling) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in _texts(batch.column(1)):
                n_words, n_features, weight = np.zeros((3, len(part)), dtype=np.int64)
                for length, owner, sums in features(part, rule.n):
                    count = np.bincount(owner, minlength=len(part))
                    n_features += count
                    if length == 1:
                        n_words += count
                    np.add.at(weight, owner, gain[sums % rule.buckets])
                ids = batch.column(0).slice(rows.start, len(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_words), pa.array(n_features), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(ids: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate made from the id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ids.cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, rule: Sampling) -> DataFrame:
    """Adds the rank of the drawn rows; ``scored`` is a stored table."""
    able = (F.col("n_words") >= rule.least_words) & F.col("score").isNotNull()
    order = [F.desc("able"), F.desc_nulls_last("score"), "doc_id", F.desc("n_features"), "spread"]
    rows = scored.select("*", able.alias("able"), F.monotonically_increasing_id().alias("spread"))
    placed = stage(rows.orderBy(*order).drop("spread").withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("able").alias("able_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sizes = sizes.select(  # a row for each partition of the sort
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("shift"),
        F.floor(F.sum("able_rows").over(everything) * rule.percent / 100).alias("drawn"),
    )
    place = F.col("shift") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    found = placed.join(F.broadcast(sizes), part == F.col("part"))
    return found.withColumn("rank", F.when(place <= F.col("drawn"), place))


def resample(documents: DataFrame, target: DataFrame, rule: Sampling = Sampling()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``documents``; rank is null if not drawn."""
    gain = gains(bucket_counts(documents, rule), bucket_counts(target, rule))
    weighed = stage(weigh(documents, gain, rule), "weights")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), rule.seed))
    return ranked(scored, rule).select("doc_id", "n_features", "weight", "score", "rank")
