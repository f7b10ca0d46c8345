"""Quality scores by kernel ridge regression on statistics of the text.

Each text becomes a short vector of statistics (lengths, shares of kinds of characters,
repetition). Random Fourier features approximate a Gaussian kernel on the standardised
vectors; every partition sums its part of the normal equations, the parts are added in
rounds, and a ridge solution gives a raw score. The equations are kept per fold, so the
sums also give models that have not seen a fold, and isotonic regression of the labels on
these held-apart raw scores calibrates the score. The statistics are computed once, from
whole texts, and written to the shared folder; all later passes read only them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import id_share, stage, training_labels, tree_sum
from larder.llm.textarrays import Words, mix, words_of

FOLDS = 5
FOURIER = 256
BINS = 1024
RIDGE = 1e-3

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "shout": b"!?",
    "stop": b".,;:",
    "markup": b"{}[]()=_/\\@~^+-\"'`",
    "line": b"\n",
    "other": bytes(range(128, 256)),
}
_KIND_OF = np.zeros(256, dtype=np.uint8)
for _number, _members in enumerate(_KINDS.values(), 1):
    _KIND_OF[list(_members)] = _number
N_STATISTICS = 12 + len(_KINDS)


def _repeated(owner: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values each text has, and how many of them are distinct."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o, minlength=texts), np.bincount(o[new], minlength=texts)


def _statistics(words: Words) -> np.ndarray:
    """One row of numbers for each text; all zeros for an empty one."""
    texts, owner, counts = len(words.rows), words.owner(), words.counts
    size = np.diff(words.text_bounds)
    of_byte = np.repeat(np.arange(texts), size)
    kinds = np.bincount(
        of_byte * (len(_KINDS) + 1) + _KIND_OF[words.data], minlength=texts * (len(_KINDS) + 1)
    ).reshape(texts, -1)[:, 1:]
    length = (words.ends - words.starts).astype(np.float64)
    some, bytes_ = np.maximum(counts, 1), np.maximum(size, 1)
    mean = np.bincount(owner, weights=length, minlength=texts) / some
    square = np.bincount(owner, weights=length**2, minlength=texts) / some
    hashes = words.hashes()
    _, kinds_of_words = _repeated(owner, hashes, texts)

    inside = np.ones(len(hashes), dtype=bool)
    ends = words.bounds[1:]
    for back in (1, 2):
        inside[np.maximum(ends - back, 0)[counts >= back]] = False
    at = np.flatnonzero(inside)
    triples = mix(hashes[at] ^ mix(hashes[at + 1] ^ mix(hashes[at + 2])))
    many, distinct = _repeated(owner[at], triples, texts)

    lines = kinds[:, list(_KINDS).index("line")] + 1
    last = words.data[words.ends - 1] if len(hashes) else words.data[:0]
    first = words.data[words.starts] if len(hashes) else words.data[:0]
    share = lambda mask: np.bincount(owner, weights=mask, minlength=texts) / some
    out = np.zeros((texts, N_STATISTICS))
    out[:, 0] = np.log1p(counts)
    out[:, 1] = np.log1p(mean)
    out[:, 2] = np.sqrt(np.maximum(square - mean**2, 0))
    out[:, 3] = kinds_of_words / some
    out[:, 4] = kinds_of_words / np.sqrt(some)
    out[:, 5] = 1 - distinct / np.maximum(many, 1)
    out[:, 6] = np.log1p(counts / lines)
    out[:, 7] = share(length <= 3)
    out[:, 8] = share((_KIND_OF[last] > 2) & (_KIND_OF[last] < 8))
    out[:, 9] = share(_KIND_OF[first] == 1)
    out[:, 10] = share(length == 1)
    full = counts > 0
    if full.any():
        out[full, 11] = np.log1p(np.maximum.reduceat(length, words.bounds[:-1][full]))
    out[:, 12:] = np.sqrt(kinds / bytes_[:, None])
    out[size == 0] = 0
    return out


def document_statistics(documents: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1)):
                values = pa.array(_statistics(words).astype(np.float32).ravel())
                rows = pa.FixedSizeListArray.from_arrays(values, N_STATISTICS).cast(pa.list_(pa.float32()))
                ids = batch.column(0).slice(words.rows.start, len(words.rows))
                yield pa.RecordBatch.from_arrays([ids, rows], names=["doc_id", "statistics"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, statistics array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _parts(frame: DataFrame, compute) -> np.ndarray | None:
    """The sum over all batches of the array that ``compute`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = compute(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return tree_sum(frame.mapInArrow(run, "part binary"))


def isotonic(hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of hits by bin: pool adjacent violators.

    Each bin starts with a hundredth of a row at the overall share, which fills empty bins.
    """
    overall = hits.sum() / max(counts.sum(), 1)
    blocks: list[list[float]] = []
    for hit, count in zip(hits + 0.01 * overall, counts + 0.01, strict=True):
        blocks.append([hit, count, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] > blocks[-1][0] * blocks[-2][1]:
            hit, count, bins = blocks.pop()
            blocks[-1] = [blocks[-1][0] + hit, blocks[-1][1] + count, blocks[-1][2] + bins]
    return np.concatenate([np.full(int(bins), hit / count) for hit, count, bins in blocks])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve: np.ndarray

    def fourier(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.c_[np.ones(len(z)), waves]

    def bins(self, raw: np.ndarray) -> np.ndarray:
        """Raw scores from -0.5 to 1.5 in even bins, the rest in the outer ones."""
        return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1e-6)

    def scores(self, statistics: np.ndarray) -> np.ndarray:
        at = self.bins(self.fourier(statistics) @ self.weights)
        return np.clip(np.interp(at, np.arange(BINS) + 0.5, self.curve), 0, 1)


def fit_quality(
    statistics: DataFrame,
    labels: DataFrame,
    column: str = "quality",
    modulus: int = 3,
    kept_out: int = 1,
    most_rows: int = 200_000,
) -> QualityModel:
    """Learns from the statistics of labelled documents that are not kept out.

    ``most_rows`` bounds the labelled documents (see ``training_labels``). Without any, every
    text scores 0.5; with labels of one class, about 0 or 1.
    """
    known = training_labels(labels, column, modulus, kept_out, most_rows)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    train = statistics.join(F.broadcast(known), "doc_id").select("statistics", "label", fold)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)])

    total = _parts(train, moments)
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(N_STATISTICS, FOURIER)) / np.sqrt(N_STATISTICS)
    phases = rng.uniform(0, 2 * np.pi, FOURIER)
    if total is None:
        still = np.zeros(N_STATISTICS)
        return QualityModel(still, still + 1, directions, phases, np.zeros(FOURIER + 1), np.full(BINS, 0.5))
    n, mean = total[0], total[1 : N_STATISTICS + 1] / total[0]
    spread = np.sqrt(np.maximum(total[N_STATISTICS + 1 :] / n - mean**2, 0))
    spread = np.where(spread > 1e-6, spread, 1.0)
    model = QualityModel(mean, spread, directions, phases, np.zeros(FOURIER + 1), np.zeros(BINS))
    width = FOURIER + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.fourier(_matrix(batch.column(0)))
        y, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        out = np.zeros((FOLDS, width, width + 1))
        for k in np.unique(of):
            mine = z[of == k]
            out[k] = mine.T @ np.c_[mine, y[of == k]]
        return out.ravel()

    sums = _parts(train, equations).reshape(FOLDS, width, width + 1)

    def solve(part: np.ndarray) -> np.ndarray:
        rows = max(part[0, 0], 1.0)
        damp = np.full(width, RIDGE * rows / 10)
        damp[0] = 1e-6
        return np.linalg.solve(part[:, :-1] + np.diag(damp), part[:, -1])

    apart = np.stack([solve(sums.sum(axis=0) - sums[k]) for k in range(FOLDS)])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        y, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        raw = (model.fourier(_matrix(batch.column(0))) * apart[of]).sum(axis=1)
        at = model.bins(raw).astype(int)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    hits, counts = _parts(train, histogram).reshape(2, BINS)
    return QualityModel(mean, spread, directions, phases, solve(sums.sum(axis=0)), isotonic(hits, counts))


def score_quality(statistics: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row; the score rises from 0 to 1 with likelier label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.scores(_matrix(batch.column(1)))) if batch.num_rows else pa.array([], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], names=["doc_id", "score"])

    kind = statistics.schema["doc_id"].dataType.simpleString()
    return statistics.select("doc_id", "statistics").mapInArrow(run, f"doc_id {kind}, score double")


def classify_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score) of every document.

    Repeated rows each get a row. A null or empty text is scored from statistics of 0.
    """
    statistics = stage(document_statistics(documents), "statistics")
    scored = score_quality(statistics, fit_quality(statistics, labels))
    return scored.select("doc_id", (id_share(F.col("doc_id"), 3) == 1).alias("held_out"), "score")
