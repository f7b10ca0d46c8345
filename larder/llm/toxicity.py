"""Toxicity by class-conditional Kneser-Ney models.

Two word models, of toxic and of ordinary documents, score a text. Both count contexts,
not occurrences: a word counts once for each distinct word before it in the class, so a
text copied a thousand times or a word repeated in one text weighs as one. A model backs
off from the word to its first bytes, the same for all inflected forms of a stem, and
from there to one distribution of both classes together, so an expression neither class
has seen speaks for neither:

    p(w | class) = max(c(w) - D, 0) / N + D * T / N * p_shared(w) * r(prefix, class)
    r(prefix, class) = (max(c(prefix) - D, 0) / N + D * T' / N * p_shared(prefix)) / p_shared(prefix)

The log-likelihood differences of a text's words are length-normalised in several ways
(over the whole text, over its best window of words, its strongest words, their total by
the root of the length), and a logistic regression on these gives the score. It is fitted
on the training texts themselves, each scored without its own contexts.

The contexts of all labelled texts are counted; only the regression is fitted on a bounded
share of them. Words and prefixes are counted in hash buckets, at least two for every distinct
word and prefix counted, so the model grows with the vocabulary: 2 counts of 4 bytes a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import fresh, hashed_sample, stage, training_labels, with_columns
from larder.llm.textarrays import Words, mix, words_of

#: The least numbers of buckets, and the bits by which words and prefixes are told apart.
WORD_BUCKETS = 1 << 21
PREFIX_BUCKETS = 1 << 19
WORD_BITS, PREFIX_BITS = 37, 25
PREFIX_BYTES = 5
WINDOW = 16
DISCOUNT = 0.75
N_FEATURES = 8
MOST_SHIPPED = 2_000_000


def _buckets(
    words: Words, word_buckets: int = WORD_BUCKETS, prefix_buckets: int = PREFIX_BUCKETS
) -> tuple[np.ndarray, np.ndarray]:
    """The word and the prefix bucket of each word; numbers of buckets are powers of two."""
    whole = words.hashes() % np.uint64(word_buckets)
    stem = words.hashes(prefix=PREFIX_BYTES) % np.uint64(prefix_buckets)
    return whole.astype(np.int64), stem.astype(np.int64)


def _room(distinct: int, least: int) -> int:
    """A power of two with two buckets or more for each of ``distinct``."""
    return max(least, 1 << (2 * distinct - 1).bit_length()) if distinct else least


def _contexts(words: Words, buckets: np.ndarray) -> np.ndarray:
    """A hash of each word with the word before it; a text's first word has none before."""
    before = np.zeros(len(buckets), dtype=np.int64)
    before[1:] = buckets[:-1] + 1
    first = words.bounds[:-1]
    before[first[first < words.bounds[1:]]] = 0
    return mix(mix(before.astype(np.uint64)) + buckets.astype(np.uint64)).view(np.int64)


@dataclass(frozen=True)
class Counts:
    """Contexts by bucket: row 0 of ordinary, row 1 of toxic documents."""

    words: np.ndarray
    prefixes: np.ndarray
    totals: np.ndarray
    kinds: tuple[np.ndarray, np.ndarray]

    @classmethod
    def of(cls, words: np.ndarray, prefixes: np.ndarray) -> Counts:
        totals = np.maximum(words.sum(axis=1, dtype=np.float64), 1.0)
        kinds = tuple(np.maximum((x > 0).sum(axis=1), 1) for x in (words, prefixes))
        return cls(words, prefixes, totals, kinds)

    def differences(self, words, prefixes, own_words, own_prefixes, own_class) -> np.ndarray:
        """log p(w | toxic) - log p(w | ordinary), without a text's own contexts."""
        totals, (seen, stems) = self.totals, self.kinds
        both, weight = totals.sum(), 0.5
        of_word, of_stem = self.words[:, words], self.prefixes[:, prefixes]
        if own_class is not None:
            for c in (0, 1):
                mine = own_class == c
                of_word[c] = np.maximum(of_word[c] - np.where(mine, own_words, 0), 0)
                of_stem[c] = np.maximum(of_stem[c] - np.where(mine, own_prefixes, 0), 0)
        shared_word = (of_word.sum(axis=0) + weight) / (both + weight * self.words.shape[1])
        shared_stem = (of_stem.sum(axis=0) + weight) / (both + weight * self.prefixes.shape[1])
        logs = []
        for c in (0, 1):
            rest = DISCOUNT * stems[c] / totals[c]
            stem = np.maximum(of_stem[c] - DISCOUNT, 0) / totals[c] / shared_stem + rest
            rest = DISCOUNT * seen[c] / totals[c]
            word = np.maximum(of_word[c] - DISCOUNT, 0) / totals[c] + rest * shared_word * stem
            logs.append(np.log(word))
        return logs[1] - logs[0]


def _features(words: Words, counts: Counts, own_class: np.ndarray | None) -> np.ndarray:
    """The length-normalised differences of each text; zeros for one without words."""
    word_buckets, prefix_buckets = counts.words.shape[1], counts.prefixes.shape[1]
    whole, stem = _buckets(words, word_buckets, prefix_buckets)
    owner, lengths, texts = words.owner(), words.counts, len(words.rows)
    out = np.zeros((texts, N_FEATURES))
    if not len(whole):
        return out
    key = owner * word_buckets + whole
    distinct, first, place = np.unique(key, return_index=True, return_inverse=True)
    mine = mine_stem = classes = None
    if own_class is not None:
        context = _contexts(words, whole)
        order = np.lexsort((context, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1])
        mine = np.bincount(place[order][new], minlength=len(distinct))[place]
        stem_key = owner * prefix_buckets + stem
        _, stem_place = np.unique(stem_key, return_inverse=True)
        mine_stem = np.bincount(stem_place[order][new], minlength=stem_place.max() + 1)[stem_place]
        classes = own_class[owner]
    value = counts.differences(whole, stem, mine, mine_stem, classes)

    sums = np.concatenate([[0.0], np.cumsum(value)])
    starts, ends = words.bounds[:-1], words.bounds[1:]
    out[:, 0] = (sums[ends] - sums[starts]) / np.maximum(lengths, 1)
    reach = np.minimum(np.arange(len(value)) + WINDOW, ends[owner])
    window = (sums[reach] - sums[:-1]) / WINDOW
    full = lengths > 0
    out[full, 1] = np.maximum.reduceat(window, starts[full])

    strength, of = value[first], owner[first]
    order = np.lexsort((-strength, of))
    strength, of = strength[order], of[order]
    begin = np.searchsorted(of, np.arange(texts))
    many = np.bincount(of, minlength=texts)
    for k in range(3):
        has = many > k
        out[has, 2 + k] = strength[begin[has] + k]
    strong = np.bincount(of, weights=np.maximum(strength - 1.5, 0), minlength=texts)
    out[:, 5] = np.log1p(lengths)
    out[:, 6] = strong / np.sqrt(np.maximum(many, 1))
    out[:, 7] = np.log1p(strong)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the constant."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    damp = np.full(len(w), ridge)
    damp[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gain = z.T @ (y - p) - damp * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(damp + 1e-9)
        w = w + np.linalg.solve(curve, gain)
    return w


@dataclass(frozen=True)
class ToxicityModel:
    """Counts shipped to the executors, and the regression on top of them."""

    counts: object  # a broadcast variable of Counts, or None without both classes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.counts is None:
            return out
        for words in words_of(texts):
            x = (_features(words, self.counts.value, None) - self.mean) / self.spread
            value = self.weights[0] + x @ self.weights[1:]
            p = 1 / (1 + np.exp(-np.clip(value, -35, 35)))
            out[words.rows.start : words.rows.stop] = np.where(words.counts > 0, p, self.prior)
        return out


def _shippable(labels: DataFrame) -> DataFrame:
    """The labels, marked for a broadcast if they are few enough."""
    return F.broadcast(labels) if labels.count() <= MOST_SHIPPED else labels


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    column: str = "toxic",
    modulus: int = 3,
    kept_out: int = 1,
    most_rows: int = 200_000,
) -> ToxicityModel:
    """Learns from documents whose id is labelled and not kept out.

    Contexts are counted from all of them; ``most_rows`` bounds those the regression is fitted
    on, a share by id hash. Up to ``MOST_SHIPPED`` labels, 16 bytes each, are broadcast; more
    are joined by a shuffle. Labels without a document, or documents without text, add nothing. Without a text of either class the score is the
    share of toxic labels for every text, or 0 without labels.
    """
    spark = documents.sparkSession
    known = training_labels(labels, column, modulus, kept_out, most_rows=1 << 62)
    texts = documents.select("doc_id", "text")
    train = texts.join(_shippable(known), "doc_id").select("text", "label")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for words in words_of(batch.column(0)):
                if not len(words.starts):
                    continue
                whole, stem = _buckets(words, 1 << WORD_BITS, 1 << PREFIX_BITS)
                of = label[words.rows.start : words.rows.stop][words.owner()]
                context = _contexts(words, whole)
                packed = (((whole << PREFIX_BITS) + stem) << 1) + of
                order = np.lexsort((context, packed))
                new = np.ones(len(order), dtype=bool)
                a, b = packed[order], context[order]
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[new]), pa.array(b[new])], names=["packed", "context"]
                )

    distinct = train.mapInArrow(contexts, "packed long, context long").distinct()
    by_word = distinct.groupBy("packed").agg(F.count("*").alias("n"))
    table = stage(
        by_word.select(
            (F.col("packed") % 2).cast("int").alias("of"),
            F.shiftright("packed", PREFIX_BITS + 1).alias("word"),
            (F.shiftright("packed", 1) % (1 << PREFIX_BITS)).alias("stem"),
            "n",
        ),
        "toxic-words",
    )
    seen = [table.select(name).distinct().count() for name in ("word", "stem")]
    sizes = [_room(seen[0], WORD_BUCKETS), min(_room(seen[1], PREFIX_BUCKETS), 1 << PREFIX_BITS)]
    stacked = table.select(
        "of", F.expr(f"stack(2, 0, word % {sizes[0]}, 1, stem % {sizes[1]}) as (kind, bucket)"), "n"
    )
    rows = stacked.groupBy("of", "kind", "bucket").agg(F.sum("n").cast("int").alias("n")).toArrow()
    of, kind, bucket, n = (rows.column(c).to_numpy() for c in ("of", "kind", "bucket", "n"))
    arrays = [np.zeros((2, size), dtype=np.float32) for size in sizes]
    for k in (0, 1):
        chosen = kind == k
        arrays[k][of[chosen], bucket[chosen]] = n[chosen]
    counts = Counts.of(*arrays)
    prior = float(known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0])
    if not (arrays[0].sum(axis=1) > 0).all():
        return ToxicityModel(None, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), prior)
    shipped = spark.sparkContext.broadcast(counts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for words in words_of(batch.column(0)):
                of = label[words.rows.start : words.rows.stop]
                x = np.c_[of, _features(words, shipped.value, of)][words.counts > 0]
                columns = [pa.array(np.ascontiguousarray(x[:, i])) for i in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["label", *(f"f{i}" for i in range(N_FEATURES))]
    fitted = hashed_sample(known, F.col("doc_id"), most_rows)
    fit = texts.join(_shippable(fitted), "doc_id").select("text", "label")
    sample = fit.mapInArrow(features, ", ".join(f"{name} double" for name in names)).toArrow()
    data = np.stack([sample.column(name).to_numpy() for name in names], axis=1)
    data = data[np.lexsort(data.T)]  # the fit must not depend on the order of partitions
    y, x = data[:, 0], data[:, 1:]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    return ToxicityModel(shipped, mean, spread, _logistic((x - mean) / spread, y), prior)


def score_toxicity(documents: DataFrame, model: ToxicityModel, score: str = "score") -> DataFrame:
    """The rows of ``documents`` with a score from 0 to 1 added, higher for likelier toxic.

    A text that is null or has no word gets the share of toxic labels. All columns stay.
    """
    field = T.StructField(score, T.DoubleType())
    return with_columns(documents, "text", [field], lambda texts: [pa.array(model.scores(texts))])


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is under the threshold, with their columns as they were."""
    (score,) = fresh(documents, "toxicity")
    model = fit_toxicity(documents, labels)
    scored = score_toxicity(documents, model, score)
    return scored.where(F.col(score) < threshold).select(*documents.columns)
