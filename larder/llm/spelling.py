"""Spelling variants by Bloom-guided neighbourhoods.

Words near each other differ by one code point. Instead of comparing words, each generates
its edits, and a filter over the vocabulary tells which of them may be words: a Bloom
filter in blocks of one 64-bit number, with a range of blocks (a shard) for each word
length. Only edits the filter lets pass become strings and are shuffled to an exact join
with the vocabulary, which removes the false ones. A replaced code point is tried upwards
only and a deletion stands for the insertion it undoes, so each pair is found once.

The hash of a word is a sum of its code points' numbers times powers of a constant, so that
of an edit follows from the word's by one addition, for many words at a time. Collisions
cost work only: the join decides.

The filter has a proven size: at most ``MOST_BLOCKS`` numbers (32 MiB) are broadcast at a
time. A larger vocabulary is cut into slices by hash, each with a filter of its own, and
the edits are generated once for each slice.

A word's form is its near word with the most occurrences if it has ``factor`` times as many.
Occurrences grow by that factor along forms, so paths are short and have no circles; roots
are found by doubling the steps.

Defined results: null and empty texts have no words. A row without doc_id has its words
unaltered. Repeated rows count each time. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import stage
from larder.llm.textarrays import mix

#: Code points of words, A-Z already lower-cased; all fit in Latin-1.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], dtype=np.uint8)
KEYS_A_BLOCK = 4
MOST_BLOCKS = 1 << 22
LONGEST_SHARD = 64
WORDS_AT_ONCE = 200_000
LETTERS_AT_ONCE = 1 << 24
PLACES_AT_ONCE = 1 << 13

_CODES = np.random.default_rng(41).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))


@dataclass(frozen=True)
class Spelling:
    """Words of ``least_length`` and more that occur ``least_n`` times; forms have ``factor`` times as many."""

    least_length: int = 6
    least_n: int = 5
    factor: int = 5
    slip: int = 199


def vocabulary(documents: DataFrame, rule: Spelling) -> DataFrame:
    """(word, n) of all words, each run altered as its document's id and crc32 say."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{rule.least_length},}}")

    def emit(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, letters = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                lowered = text.encode().lower().decode() if text else ""
                for word, times in Counter(runs.findall(lowered)).items():
                    h = 1 if doc_id is None else crc32(f"{doc_id}:{word}".encode())
                    if h % rule.slip == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < rule.least_length:
                            continue
                    if word not in counts:
                        letters += len(word)
                    counts[word] += times
                if len(counts) > WORDS_AT_ONCE or letters > LETTERS_AT_ONCE:
                    yield emit(counts)
                    counts, letters = Counter(), 0
        yield emit(counts)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= rule.least_n)


@dataclass(frozen=True)
class Shards:
    """Where the blocks of each length begin, and how many slices the keys are cut into."""

    first: np.ndarray
    blocks: np.ndarray
    slices: int

    @staticmethod
    def of(counts: dict[int, int], most_blocks: int) -> Shards:
        """For so many words of each length, ``LONGEST_SHARD`` standing for all longer ones."""
        wanted = np.zeros(LONGEST_SHARD + 1, dtype=np.int64)
        for length, count in counts.items():
            wanted[length] = -(-count // KEYS_A_BLOCK)
        slices = max(1, -(-int(wanted.sum()) // most_blocks))
        blocks = -(-wanted // slices)
        return Shards(np.cumsum(blocks) - blocks, blocks, slices)

    def place(self, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slice, block and bits of each key; block -1 where no word has the length."""
        shard = np.minimum(lengths, LONGEST_SHARD)
        blocks = self.blocks[shard]
        block = self.first[shard] + ((keys >> np.uint64(24)) % np.maximum(blocks, 1).astype(np.uint64)).astype(np.int64)
        bits = np.zeros(len(keys), dtype=np.uint64)
        for step in range(4):
            bits |= np.uint64(1) << ((keys >> np.uint64(6 * step)) & np.uint64(63))
        cut = (mix(keys) % np.uint64(self.slices)).astype(np.int64) if self.slices > 1 else np.zeros(len(keys), np.int64)
        return cut, np.where(blocks > 0, block, -1), bits


class Flat:
    """Words as one array of code points, with the sums their edits' hashes come from."""

    def __init__(self, words: list[str]) -> None:
        self.lengths = np.array([len(word) for word in words], dtype=np.int64)
        self.codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        ends = np.cumsum(self.lengths)
        self.owner = np.repeat(np.arange(len(words)), self.lengths)
        self.at = np.arange(len(self.codes)) - (ends - self.lengths)[self.owner]
        powers = np.full(int(self.lengths.max(initial=0)) + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        self.power = np.multiply.accumulate(powers)[self.at]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_CODES[self.codes] * self.power)])
        self.ends = ends
        self.total = self.sums[ends] - self.sums[ends - self.lengths]

    def keys(self) -> np.ndarray:
        return mix(self.total + self.lengths.astype(np.uint64))

    def edits(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, new code or 0 for a deletion, key, length) of the edits at the places a to b."""
        places = np.arange(a, b)
        of = self.owner[places]
        last = places + 1 == self.ends[of]
        after = self.codes[np.minimum(places + 1, len(self.codes) - 1)]
        gone = places[last | (after != self.codes[places])]  # of equal neighbours the last
        of_gone = self.owner[gone]
        before = self.sums[gone] - self.sums[self.ends[of_gone] - self.lengths[of_gone]]
        behind = (self.sums[self.ends[of_gone]] - self.sums[gone + 1]) * _BACK
        length = self.lengths[of_gone] - 1
        yield gone, np.zeros(len(gone), np.uint8), mix(before + behind + length.astype(np.uint64)), length
        row, letter = np.nonzero(ALPHABET[None, :] > self.codes[places][:, None])
        place, new = places[row], ALPHABET[letter]
        changed = self.total[self.owner[place]] + (_CODES[new] - _CODES[self.codes[place]]) * self.power[place]
        length = self.lengths[self.owner[place]]
        yield place, new, mix(changed + length.astype(np.uint64)), length


def build_filter(words: DataFrame, shards: Shards, cut: int) -> np.ndarray:
    """The blocks of a slice: bits of equal blocks are put together on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = Flat(batch.column(0).to_pylist())
            part, block, bits = shards.place(flat.keys(), flat.lengths)
            mine = part == cut
            columns = [pa.array(block[mine]), pa.array(bits[mine].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bits"])

    marked = words.select("word").mapInArrow(run, "block long, bits long")
    rows = marked.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()  # MOST_BLOCKS rows at most
    filled = np.zeros(int(shards.blocks.sum()), dtype=np.uint64)
    filled[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return filled


def candidates(words: DataFrame, shards: Shards, cut: int, shipped) -> DataFrame:
    """(word, n, near) for every edit of a word that passes the filter of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shipped.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            flat = Flat(texts)
            for a in range(0, len(flat.codes), PLACES_AT_ONCE):
                for place, new, key, length in flat.edits(a, min(a + PLACES_AT_ONCE, len(flat.codes))):
                    part, block, bits = shards.place(key, length)
                    passes = (part == cut) & (block >= 0)
                    passes &= (blocks[np.maximum(block, 0)] & bits) == bits
                    place, new = place[passes], new[passes]
                    of, at = flat.owner[place], flat.at[place]
                    near = [
                        texts[o][:i] + (chr(c) if c else "") + texts[o][i + 1 :]
                        for o, i, c in zip(of.tolist(), at.tolist(), new.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(near, pa.string())],
                        names=["word", "n", "near"],
                    )

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def near_pairs(words: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(word, n, near, near_n), each pair of near words once; ``words`` is a stored table."""
    spark = words.sparkSession
    length = F.least(F.char_length("word"), F.lit(LONGEST_SHARD)).alias("length")
    counts = {row.length: row["count"] for row in words.groupBy(length).count().collect()}
    shards = Shards.of(counts, most_blocks)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = None
    for cut in range(shards.slices):
        shipped = spark.sparkContext.broadcast(build_filter(words, shards, cut))
        pairs = stage(candidates(words, shards, cut, shipped).join(known, "near"), "pairs")
        shipped.unpersist()
        found = pairs if found is None else found.unionByName(pairs)
    return found.select("word", "n", "near", "near_n")


def roots(forms: DataFrame, rule: Spelling) -> DataFrame:
    """(word, root) from (word, form): the end of the path of forms."""
    steps = math.ceil(math.log2(63 / math.log2(rule.factor))) if rule.factor < 2**63 else 1
    paths = forms.select("word", F.col("form").alias("root"))
    for _ in range(steps):
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = stage(
            paths.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"
        )
    return paths


def variants(documents: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    if rule.factor < 2:
        raise ValueError("forms need at least twice the occurrences, else their paths may be circles")
    words = stage(vocabulary(documents, rule), "words")
    pairs = near_pairs(words)
    turned = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.unionByName(turned).groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"),
    )
    joined = words.join(best, "word", "left")
    taken = -F.col("best.less") >= rule.factor * F.col("n")
    rows = stage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, F.col("best.near")).alias("form"),
            F.when(taken, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(rows.where("form IS NOT NULL"), rule)
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
