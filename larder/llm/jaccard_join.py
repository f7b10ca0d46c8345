"""Exact n-gram Jaccard join by prefix trees.

A ``Rule`` holds the length of the shingles and the threshold ``num / den``. A document's set
is its distinct shingles; shingles are ordered by their 64-bit hash, the
same for all documents, so a set is a path in a tree. Documents of equal sets are one node
from the start. The order's range is cut into segments, more than two linked sets can
differ in: sets with ``den * common >= num * union`` agree on whole segments of their paths,
and sets that agree on one meet (a running first value by segment, no group is gathered).
The components of that meeting relation are blocks no link leaves. Inside a block the sets
are stored in a tree with common beginnings shared; a query walks it with the overlap so
far, leaves subtrees that cannot reach the overlap their lengths ask for, and skips those
whose documents are all in its component already.

Sizes are dealt with in levels, ``(num / den) ** 2`` apart; a set takes part in its own level and in that
of the largest set it can link with. A level of sizes up to s has ``k + 1 + SPARE`` segments,
k the largest difference of two linked sets. Segments of fewer than two shingles meet by
chance; two linked sets agree on more than ``SPARE`` segments, so such segments are used
only by sets that have more than ``SPARE`` of them.

Under a threshold of 85/100 segments hold so few shingles that most would meet by chance. There
sets meet by the shingles of their prefixes instead, within a level: in any one order of all
shingles, linked sets share one of their first ``size - ceil(size * num / den) + 1``. The order
puts rare shingles first, by the magnitude of counts in hash buckets, a byte each; which order
it is has no effect on the links, only on how many sets meet that have none.

A block of many shingles is dealt out as pairs of chunks, each with bounded memory, and
their links are joined to components afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import components, stage
from larder.llm.textarrays import Words, mix, words_of
from larder.session import releasing

SPARE = 2
LEAST_SEGMENT_THRESHOLD = 0.85
MOST_RANK_BITS = 25
CHUNK_SHINGLES = 1_000_000
BITS = 1 << 24
PAGE = 2048


@dataclass(frozen=True)
class Rule:
    """Sets of distinct ``n``-word shingles link when ``den * common >= num * union``."""

    n: int = 3
    num: int = 90
    den: int = 100

    @property
    def by_segments(self) -> bool:
        return self.num >= LEAST_SEGMENT_THRESHOLD * self.den

    @cached_property
    def levels(self) -> np.ndarray:
        """The least size of each level; linked sets are at most one level apart."""
        levels = [1]
        while levels[-1] < 1 << 40:
            levels.append(max(levels[-1] + 1, levels[-1] * self.den**2 // self.num**2))
        return np.array(levels)

    def segments(self, level: np.ndarray) -> np.ndarray:
        """How many segments the sets of a level are cut into."""
        largest = self.levels[level + 1] - 1
        return largest * 2 * (self.den - self.num) // (self.den + self.num) + 1 + SPARE

    def prefix(self, sizes: np.ndarray) -> np.ndarray:
        """How many shingles, first in any order, hold one that linked sets share."""
        return np.where(sizes > 0, sizes + (-sizes * self.num) // self.den + 1, 0)


OP2 = Rule()


def _sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts in a row, ordered in each, and the texts' bounds."""
    hashes, counts, texts = words.hashes(), words.counts, len(words.rows)
    at = np.arange(len(hashes))
    room = words.bounds[1:][words.owner()] - at
    grams = mix(hashes + np.uint64(1))
    for step in range(1, n):
        here = room > step
        grams[here] = mix(grams[here] ^ mix(hashes[at[here] + step] + np.uint64(step + 1)))
    start = words.bounds[:-1][words.owner()]
    keep = (room >= n) | ((counts[words.owner()] < n) & (at == start))
    owner, grams = words.owner()[keep], grams[keep]
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    owner, grams = owner[new], grams[new]
    return grams, np.searchsorted(owner, np.arange(texts + 1))


def _signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart; zeros for empty sets."""
    out = []
    for salt in (0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D):
        sums = np.zeros(len(grams) + 1, dtype=np.uint64)
        np.cumsum(mix(grams ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out[0], out[1]


def _keys(grams: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for every segment by which a text's set can meet others."""
    sizes = np.diff(bounds)
    texts, keys = [], []
    own = np.searchsorted(rule.levels, sizes, side="right") - 1
    above = np.searchsorted(rule.levels, sizes * rule.den // rule.num, side="right") - 1
    marked = mix(grams ^ np.uint64(0x369DEA0F31A53F85))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for level, takes in ((own, sizes > 0), (above, (sizes > 0) & (above > own))):
        count = np.where(takes, rule.segments(np.maximum(level, 0)), 0)
        takes &= count > 1 + SPARE  # else only equal sets can link
        count[~takes] = 0
        if not takes.any():
            continue
        first = np.concatenate([[0], np.cumsum(count)])
        used = takes[owner]
        of = owner[used]
        part = ((grams[used] >> np.uint64(32)) * count[of].astype(np.uint64)) >> np.uint64(32)
        slot = first[of] + part.astype(np.int64)
        filled = np.bincount(slot, minlength=first[-1])
        sums = np.zeros(used.sum() + 1, dtype=np.uint64)
        np.cumsum(marked[used], out=sums[1:])
        ends = np.cumsum(filled)
        digest = sums[ends] - sums[ends - filled]
        text = np.repeat(np.arange(len(sizes)), count)
        weak = filled < 2
        loose = np.bincount(text, weights=weak, minlength=len(sizes)) > SPARE
        use = ~weak | loose[text]
        number = (np.arange(first[-1]) - first[text]).astype(np.uint64)
        key = mix(digest + mix((level[text].astype(np.uint64) << np.uint64(40)) + number))
        texts.append(text[use])
        keys.append(key[use].astype(np.int64))
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(texts), np.concatenate(keys)


def _prefix_keys(
    grams: np.ndarray, bounds: np.ndarray, rule: Rule, ranks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for every shingle in the prefix of a text's set, the least ``ranks`` first.
    Sets meet within a level only: in their own, and in that of the largest set they link with.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((grams, ranks[_rank_bucket(grams, len(ranks))], owner))
    used = np.arange(len(grams)) - bounds[:-1][owner] < rule.prefix(sizes)[owner]
    text, gram = owner[used], grams[order][used]
    own = np.searchsorted(rule.levels, sizes, side="right") - 1
    above = np.searchsorted(rule.levels, sizes * rule.den // rule.num, side="right") - 1
    higher = (above > own)[text]
    text, gram = np.concatenate([text, text[higher]]), np.concatenate([gram, gram[higher]])
    level = np.concatenate([own[text[: len(higher)]], above[text[len(higher) :]]])
    return text, mix(gram + mix(level.astype(np.uint64))).view(np.int64)


def _rank_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(grams ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _shingle_ranks(texts: DataFrame, rule: Rule, shingles: int) -> np.ndarray:
    """The magnitude of how many sets hold the shingles of each hash bucket, a byte each.

    A bucket or two for each shingle up to the bound on buckets. Each task gives its counts,
    up to 255, in pages of 2 KB; those of a page are added up one after the other, so no task
    holds many. A task gives a byte a bucket whatever it reads, so there are no more tasks
    than keep all of them busy, or than four shingles a byte ask for.
    """
    buckets = 1 << min(max(shingles, PAGE).bit_length(), MOST_RANK_BITS)
    pages = max(buckets // PAGE, 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.uint8)
        for batch in batches:
            for words in words_of(batch.column(0)):
                grams, _ = _sets(words, rule.n)
                bucket, n = np.unique(_rank_bucket(grams, buckets), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + n, 255)
        for first in range(0, pages, 1024):
            rows = range(first, min(first + 1024, pages))
            data = [counts[page * PAGE : (page + 1) * PAGE].tobytes() for page in rows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(data, pa.binary())], names=["page", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(0, dtype=np.uint64)

        def ranked() -> pa.RecordBatch:
            ranks = np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], names=["page", "part"]
            )

        for batch in batches:
            for page, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(part.as_buffer(), dtype=np.uint8)
                if page == current:
                    total += counts
                else:
                    if current is not None:
                        yield ranked()
                    current, total = page, counts.astype(np.uint64)
        if current is not None:
            yield ranked()

    spark = texts.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, shingles // (4 * buckets))
    ranks = np.zeros(buckets, dtype=np.uint8)
    with releasing(spark):
        parts = texts.select("text").coalesce(tasks).mapInArrow(count, "page int, part binary")
        rows = parts.repartition("page").sortWithinPartitions("page").mapInArrow(add, "page int, part binary")
        for row in rows.collect():  # MOST_RANK_BITS bound their bytes
            ranks[row.page * PAGE :][: len(row.part)] = np.frombuffer(row.part, dtype=np.uint8)
    return ranks


class _Tree:
    """Sets of a block as a tree over tokens, numbered in their common order.

    Edges hold several tokens, at most ``piece``, so that bounds are tested on the way.
    """

    def __init__(self, sets: list[np.ndarray], rule: Rule) -> None:
        self.rule = rule
        sizes = np.array([len(s) for s in sets])
        _, ranks = np.unique(np.concatenate(sets), return_inverse=True)
        parts = np.split(ranks.astype(np.int64), np.cumsum(sizes)[:-1])
        self.order = sorted(range(len(sets)), key=lambda i: parts[i].astype(">u4").tobytes())
        self.paths = [parts[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.tokens = int(ranks.max()) + 1
        piece = max(32, int(self.sizes.max()) // 8)
        shared = [0]
        for a, b in zip(self.paths, self.paths[1:], strict=False):
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared.append(int(differ[0]) if len(differ) else n)
        shared.append(0)
        low, high, start, stop, kids, text = [], [], [], [], [], []

        def node(lo: int, hi: int, depth: int) -> int:
            """The node of the sets lo..hi, which agree on their first ``depth`` tokens."""
            common = int(self.sizes[lo]) if hi - lo == 1 else min(shared[lo + 1 : hi])
            stop_at = min(common, depth + piece)
            me = len(low)
            for column, value in zip((low, high, start, stop), (lo, hi, depth, stop_at), strict=True):
                column.append(value)
            kids.append([])
            text.append(lo)
            work.append((me, lo, hi, stop_at, common))
            return me

        work: list[tuple[int, int, int, int, int]] = []
        self.roots = []
        edges = [0, *(i for i in range(1, len(sets)) if shared[i] == 0), len(sets)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            self.roots.append(node(lo, hi, 0))
        while work:
            me, lo, hi, depth, common = work.pop()
            if depth < common:
                kids[me].append(node(lo, hi, depth))
            elif hi - lo > 1:
                cuts = [lo, *(i for i in range(lo + 1, hi) if shared[i] == common), hi]
                kids[me].extend(node(a, b, depth) for a, b in zip(cuts, cuts[1:], strict=False))
        self.low, self.high, self.start, self.stop = map(np.array, (low, high, start, stop))
        self.edge = [self.paths[t][a:b] for t, a, b in zip(text, start, stop, strict=True)]
        self.edge_bounds = np.concatenate([[0], np.cumsum(self.stop - self.start)])
        self.edge_tokens = np.concatenate([*self.edge, np.zeros(0, dtype=np.int64)])
        self.kid_bounds = np.concatenate([[0], np.cumsum([len(k) for k in kids])])
        self.kids = np.array([k for row in kids for k in row], dtype=np.int64)
        self.last = np.array([e[-1] if len(e) else -1 for e in self.edge])
        self.leaf = (self.high - self.low == 1) & (self.stop == self.sizes[self.low])
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(low, high, strict=True)])
        self.most = np.array([self.sizes[a:b].max() for a, b in zip(low, high, strict=True)])

    def linked(self, text: int, free: np.ndarray) -> np.ndarray:
        """Which of the sets marked ``free`` link with the set at ``text`` (tree order)."""
        num, den = self.rule.num, self.rule.den
        size = int(self.sizes[text])
        inside = np.zeros(self.tokens, dtype=np.int64)
        inside[self.paths[text]] = 1
        upto = np.cumsum(inside)
        left = np.concatenate([[0], np.cumsum(free)])
        nodes = np.array(self.roots)
        overlap = np.zeros(len(nodes), dtype=np.int64)
        consumed = np.zeros(len(nodes), dtype=np.int64)
        found = []
        while len(nodes):
            fits = (left[self.high[nodes]] > left[self.low[nodes]]) & (
                den * self.most[nodes] >= num * size
            ) & (num * self.least[nodes] <= den * size)
            rest = np.minimum(size - consumed, self.most[nodes] - self.start[nodes])
            fits &= (den + num) * (overlap + rest) >= num * (size + self.least[nodes])
            nodes, overlap, consumed = nodes[fits], overlap[fits], consumed[fits]
            if not len(nodes):
                break
            length = self.stop[nodes] - self.start[nodes]
            of = np.repeat(np.arange(len(nodes)), length)
            at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            hits = inside[self.edge_tokens[self.edge_bounds[nodes][of] + at]]
            overlap = overlap + np.bincount(of, weights=hits, minlength=len(nodes)).astype(np.int64)
            consumed = np.where(length > 0, upto[np.maximum(self.last[nodes], 0)], consumed)
            ended = self.leaf[nodes]
            whole = nodes[ended]
            good = (den + num) * overlap[ended] >= num * (size + self.sizes[self.low[whole]])
            found.append(self.low[whole[good]])
            nodes, overlap, consumed = nodes[~ended], overlap[~ended], consumed[~ended]
            many = self.kid_bounds[nodes + 1] - self.kid_bounds[nodes]
            of = np.repeat(np.arange(len(nodes)), many)
            at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            nodes = self.kids[self.kid_bounds[nodes][of] + at]
            overlap, consumed = overlap[of], consumed[of]
        found = np.concatenate([*found, np.zeros(0, dtype=np.int64)])
        return found[free[found]]


def block_roots(ids: np.ndarray, sets: list[np.ndarray], rule: Rule = OP2) -> np.ndarray:
    """For each set of a block, the smallest id of its component."""
    tree = _Tree(sets, rule)
    free = np.ones(len(sets), dtype=bool)
    root = np.zeros(len(sets), dtype=ids.dtype)
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        members, queue = [first], [first]
        while queue and free.any():
            near = tree.linked(queue.pop(), free)
            free[near] = False
            members.extend(near)
            queue.extend(near)
        places = np.array([tree.order[m] for m in members])
        root[places] = ids[places].min()
    return root


def similar_components(documents: DataFrame, rule: Rule = OP2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are runs of non-blank bytes with A-Z lower-cased; a set holds the distinct ``n``-word
    shingles, the whole sequence if there are fewer words. Two rows link when ``den`` times the
    common shingles are at least ``num`` times all of theirs; ``component_id`` is the smallest
    doc_id a row reaches. A text that is null or without words has an empty set and stays
    alone, as does a row without doc_id (its component is null unless an equal set has an
    id). Rows with the same doc_id are rows of their own.
    """
    return _components(documents.select("doc_id", "text"), rule).select("doc_id", "n_shingles", "component_id")


def _components(documents: DataFrame, rule: Rule) -> DataFrame:
    """``similar_components`` with ``mark``, the hash of the text, and ``group``.

    Rows of equal sets, and of sets linked by others, have the same group: a number made from
    the sets and not from ids, which may repeat. It is null for empty sets.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1)):
                grams, bounds = _sets(words, rule.n)
                one, two = _signatures(grams, bounds)
                ids, marks = (batch.column(i).slice(words.rows.start, len(words.rows)) for i in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [ids, marks, pa.array(np.diff(bounds)), pa.array(one), pa.array(two)],
                    names=["doc_id", "mark", "n_shingles", "sig", "sig2"],
                )

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of each set, once a task however many of its texts have that set."""
        seen = set()
        for batch in batches:
            for words in words_of(batch.column(1)):
                grams, bounds = _sets(words, rule.n)
                one, two = _signatures(grams, bounds)
                fresh = np.zeros(len(one), dtype=bool)
                for i, both in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                    fresh[i] = both not in seen
                    seen.add(both)
                if rule.by_segments:
                    text, key = _keys(grams, bounds, rule)
                else:
                    text, key = _prefix_keys(grams, bounds, rule, ranks.value)
                text, key = text[fresh[text]], key[fresh[text]]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(one[text])], names=["key", "sig"])

    sets = stage(
        texts.mapInArrow(signatures, "doc_id long, mark long, n_shingles long, sig long, sig2 long"), "sets"
    )
    reps = (
        sets.where("n_shingles > 0")
        .groupBy("n_shingles", "sig", "sig2")
        .agg(F.min("doc_id").alias("rep"))
        .where("rep IS NOT NULL")
    )
    ranks = None
    if not rule.by_segments:
        shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0
        ranks = texts.sparkSession.sparkContext.broadcast(_shingle_ranks(texts, rule, shingles))
    # Shuffled once, by key: what several tasks say of one set gives an edge twice at most.
    met = texts.mapInArrow(postings, "key long, sig long")
    running = Window.partitionBy("key").orderBy("sig").rowsBetween(Window.unboundedPreceding, 0)
    edges = met.select(F.col("sig").alias("a"), F.first("sig").over(running).alias("b")).where("a <> b")
    blocks = components(edges)
    if ranks is not None:
        ranks.unpersist()
    active = stage(
        reps.join(blocks, F.col("sig") == F.col("node")).select("rep", "n_shingles", "sig", "root"), "active"
    )
    sizes = active.groupBy("root").agg(F.sum("n_shingles").alias("total"), F.count("*").alias("members"))
    sizes = sizes.where("members > 1").select(
        F.col("root").alias("block"), F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int").alias("chunks")
    )
    most = sizes.agg(F.max("chunks")).first()[0]
    if most is None:
        labelled = reps.select("*", F.col("sig").alias("group"), F.col("rep").alias("least"))
    else:
        links = _links(texts, active, sizes, rule)
        ends = components(links.select(F.col("sig").alias("a"), F.col("root").alias("b"))) if most > 1 else links.select(
            F.col("sig").alias("node"), "root"
        ).where("node <> root")
        grouped = reps.join(ends, F.col("sig") == F.col("node"), "left")
        grouped = stage(grouped.select(*reps.columns, F.coalesce("root", "sig").alias("group")), "groups")
        least = grouped.groupBy("group").agg(F.min("rep").alias("least"))
        labelled = grouped.join(least, "group")
    return sets.join(labelled.drop("rep"), ["n_shingles", "sig", "sig2"], "left").select(
        "doc_id", "mark", "n_shingles", "group", F.coalesce("least", "doc_id").alias("component_id")
    )


def _bits_of(df: DataFrame, column: str) -> DataFrame:
    """(place, bits): the ids of a column, modulo BITS, as bits of at most BITS / 64 numbers."""
    return df.groupBy(F.expr(f"shiftright(pmod({column}, {BITS}), 6)").alias("place")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({column}, {BITS}) % 64 AS INT))")).alias("bits")
    )


def _links(texts: DataFrame, active: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(sig, root): each set of the blocks with the least signature found linked to it."""
    chunked = active.join(sizes, F.col("root") == F.col("block"))
    chunked = stage(
        chunked.select(
            "rep", "n_shingles", "sig", "block", "chunks",
            F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
        ),
        "chunked",
    )

    field = _bits_of(chunked, "rep").toArrow()  # BITS / 64 rows at most
    maybe = np.zeros(BITS // 64, dtype=np.uint64)
    maybe[field.column("place").to_numpy()] = field.column("bits").to_numpy().view(np.uint64)
    shipped = texts.sparkSession.sparkContext.broadcast(maybe)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of documents whose id may be among the active ones."""
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = np.flatnonzero(~np.isnan(ids) if ids.dtype.kind == "f" else np.ones(len(ids), bool))
            bit = ids[known].astype(np.int64) & (BITS - 1)
            found = (shipped.value[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            part = batch.take(pa.array(known[found]))
            for words in words_of(part.column(1)):
                grams, bounds = _sets(words, rule.n)
                one, _ = _signatures(grams, bounds)
                data = [grams[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(words.rows.start, len(words.rows)),
                        pa.array(np.diff(bounds)),
                        pa.array(one),
                        pa.array(data, pa.binary()),
                    ],
                    names=["doc_id", "size", "of", "grams"],
                )

    fetched = texts.mapInArrow(shingles, "doc_id long, size long, of long, grams binary")
    rows = chunked.join(
        fetched,
        (F.col("rep") == F.col("doc_id")) & (F.col("n_shingles") == F.col("size")) & (F.col("sig") == F.col("of")),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    # An id that repeats may bring its set twice; one of equal sets is enough.
    dealt = rows.select("sig", "block", "chunk", "chunks", "grams", other.alias("other"))
    dealt = dealt.where("chunks = 1 OR chunk <> other").select(
        "block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "sig", "grams"
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def done() -> pa.RecordBatch:
            roots = block_roots(np.array(ids), sets, rule)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["sig", "root"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for *key, sig, grams in zip(*columns, strict=True):
                if key != group:
                    if len(sets) > 1:
                        yield done()
                    group, ids, sets = key, [], []
                ids.append(sig)
                sets.append(np.frombuffer(grams, dtype=np.uint64))
        if len(sets) > 1:
            yield done()

    sorted_ = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    found = stage(sorted_.mapInArrow(solve, "sig long, root long"), "links")
    shipped.unpersist()
    return found


def drop_similar(documents: DataFrame, rule: Rule = OP2) -> DataFrame:
    """One row of each component, that with the smallest doc_id, columns as they were.

    Rows without words or without doc_id stay. Of rows of a component that repeat its smallest
    doc_id one stays, that with the smallest hash of its text; rows that repeat an id in
    another component stay too. ``documents`` is read several times and should be a stored
    table. Rows that are alone in their component stay where they are: only texts whose id
    shares a bit with one of a larger component are shuffled to the exact join.
    """
    plain = [f"c{i}" for i in range(len(documents.columns))]
    place = {name: plain[i] for i, name in enumerate(documents.columns)}
    rows = documents.toDF(*plain)
    ids, texts = F.col(place["doc_id"]), F.col(place["text"])
    found = _components(rows.select(ids.alias("doc_id"), texts.alias("text")), rule)
    found = found.where("group IS NOT NULL AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    groups = found.groupBy("group").agg(first, F.count("*").alias("members"))
    kept = groups.select("first.*").distinct()
    several = found.join(groups.where("members > 1"), "group", "left_semi")
    field = F.broadcast(stage(_bits_of(several, "doc_id"), "several"))  # 4 MB at most
    number = F.pmod(ids.cast("long"), F.lit(BITS))
    marked = rows.join(field, F.shiftright(number, 6) == F.col("place"), "left")
    bit = F.call_function("shiftright", F.col("bits"), (number % 64).cast("int"))
    doubtful = F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    alone = ids.isNull() | ~F.coalesce(texts.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = (ids.cast("long") == F.col("doc_id")) & (F.xxhash64(texts) == F.col("mark"))
    chosen = marked.where(~alone & doubtful).select(*plain).join(kept, same, "left_semi")
    repeats = Window.partitionBy(ids, F.xxhash64(texts)).orderBy(ids)
    once = chosen.withColumn("turn", F.row_number().over(repeats)).where("turn = 1").drop("turn")
    sure = marked.where(alone | ~doubtful).select(*plain)
    return sure.unionByName(once).toDF(*documents.columns)
