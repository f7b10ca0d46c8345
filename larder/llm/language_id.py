"""Language by string kernels: blended-spectrum presence, Nystroem landmarks, kernel ridge.

The kernel of two texts is the number of byte n-grams (one to four bytes, A-Z folded)
present in both, divided by the root of the product of the numbers present in each.
N-grams are told apart by hash buckets, so a text is a row of bits. Landmarks are
training texts, as many of each language; on their Nystroem features one ridge regression
a language is fitted from normal equations summed by partition. Scoring multiplies a
batch's rows by the landmarks' rows folded with the solution: one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import fresh, id_share, tree_sum, with_columns
from larder.llm.textarrays import _FOLD, chunks

BUCKETS = 1 << 15
LONGEST = 4
ROWS = 256
RIDGE = 1e-3
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def presence(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the texts with a row of bits for each: the n-grams present in it."""
    for rows, data, bounds in chunks(texts):
        for low in range(0, len(rows), ROWS):
            high = min(low + ROWS, len(rows))
            part = _FOLD[data[bounds[low] : bounds[high]]].astype(np.uint64)
            edges = bounds[low : high + 1] - bounds[low]
            owner = np.repeat(np.arange(high - low), np.diff(edges))
            left = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(part))
            bits = np.zeros((high - low) * BUCKETS, dtype=bool)
            gram = np.zeros(len(part), dtype=np.uint64)
            for n in range(1, LONGEST + 1):
                gram[: len(part) - n + 1] = (gram[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
                inside = left >= n
                code = (gram[inside] | np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
                bits[owner[inside] * BUCKETS + (code >> np.uint64(49)).astype(np.int64)] = True
            yield slice(rows.start + low, rows.start + high), bits.reshape(high - low, BUCKETS)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Rows of length 1, so that products of rows are values of the kernel."""
    norm = np.sqrt(np.maximum(np.count_nonzero(bits, axis=1), 1)).astype(np.float32)
    return bits.astype(np.float32) / norm[:, None]


def _lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = np.zeros(len(texts), dtype=bool)
    for rows, data, bounds in chunks(texts):
        found = np.concatenate([[0], np.cumsum(_LETTER[data])])
        out[rows.start : rows.stop] = found[bounds[1:]] > found[bounds[:-1]]
    for i in np.flatnonzero(~out):
        text = texts[int(i)].as_py()
        out[i] = text is not None and any(c.isalpha() for c in text)
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    shift: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share of its score among all scores."""
        names, shares = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        if not self.languages:
            return list(names), shares
        for rows, bits in presence(texts):
            scores = np.clip(_unit(bits) @ self.weights + self.shift, 1e-6, 1)
            best = scores.argmax(axis=1)
            names[rows] = np.array(self.languages, dtype=object)[best]
            shares[rows] = scores.max(axis=1) / scores.sum(axis=1)
        lettered = _lettered(texts)
        names[~lettered], shares[~lettered] = "und", 0.0
        return list(names), shares


def fit_languages(
    documents: DataFrame,
    modulus: int = 4,
    kept_out: int = 2,
    most_rows: int = 20_000,
    landmarks: int = 320,
    least_rows: int = 200,
) -> LanguageModel:
    """Learns from text and language of documents that are not kept out.

    ``most_rows`` bounds the texts the ridge regression sees: when there are more, a share by
    id hash of each language, but of none fewer than ``least_rows`` as far as there are so
    many, so that no language is lost as the others grow. ``landmarks`` are spread over the
    languages, at least 8 each. Rows with null text, language or id are not used.
    """
    usable = documents.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull()
        & F.col("lang").isNotNull()
        & F.col("doc_id").isNotNull()
        & (id_share(F.col("doc_id"), modulus) != kept_out)
    )
    counts = {row.lang: row["count"] for row in usable.groupBy("lang").count().collect()}
    languages, share, steps = sorted(counts), most_rows / max(sum(counts.values()), 1), 1 << 30
    limits = [(name, int(steps * min(1.0, max(share, least_rows / counts[name])))) for name in languages]
    bounds = usable.sparkSession.createDataFrame(limits, "lang string, below long")
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < F.col("below")
    train = usable.join(F.broadcast(bounds), "lang").where(taken).select("doc_id", "text", "lang")
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    each = max(8, -(-landmarks // len(languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = train.select("doc_id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= each)
    near = train.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found in presence(batch.column(0)):
                packed = pa.array([row.tobytes() for row in np.packbits(found, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([packed], names=["bits"])

    rows = sorted({bytes(row[0]) for row in near.select("text").mapInArrow(bits, "bits binary").collect()})
    marks = _unit(np.unpackbits(np.frombuffer(b"".join(rows), np.uint8)).reshape(len(rows), -1).astype(bool))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    kept = values > 1e-6 * values.max()
    basis = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
    to_features = marks.T @ basis
    width, index = basis.shape[1] + 1, {name: i for i, name in enumerate(languages)}

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + len(index)))
        for batch in batches:
            of = np.array([index[name] for name in batch.column(1).to_pylist()], dtype=int)
            for rows, found in presence(batch.column(0)):
                z = np.c_[np.ones(len(found)), _unit(found) @ to_features].astype(np.float64)
                total += z.T @ np.c_[z, np.eye(len(index))[of[rows]]]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    total = tree_sum(train.select("text", "lang").mapInArrow(equations, "part binary"))
    total = total.reshape(width, -1)
    damp = np.full(width, RIDGE * max(total[0, 0], 1.0) / width)
    damp[0] = 1e-6
    solved = np.linalg.solve(total[:, :width] + np.diag(damp), total[:, width:])
    return LanguageModel(languages, (to_features @ solved[1:]).astype(np.float32), solved[0])


def predict_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (0 to 1) added; all columns stay.

    A column of ``documents`` that has one of these names makes the new one ``lang_pred_`` or
    ``score_``.
    A text that is null or has no letter is ``und`` with score 0, as is every text when
    nothing could be learned.
    """
    names = fresh(documents, "lang_pred", "score")
    fields = [T.StructField(name, kind) for name, kind in zip(names, (T.StringType(), T.DoubleType()), strict=True)]
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array) -> list[pa.Array]:
        names, shares = shipped.value.predict(texts)
        return [pa.array(names, pa.string()), pa.array(shares)]

    return with_columns(documents, "text", fields, compute)
