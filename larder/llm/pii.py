"""Personal data: patterns, and the terms that give protected entities away.

Mail and network addresses, cards and phone numbers are found by patterns; their values are
the protected entities. Then information theory tells which other terms reveal one. A
position counts as near an entity if it is within ``window`` words of a mention of it.
With probabilities of positions, the pointwise mutual information of entity and term over
the entity's information content, ``PMI(e; t) / IC(e)``, is the share of what identifies
the entity that the term gives away: 1 when the term occurs nowhere else. Terms from
``generalise`` on are replaced by their kind, from ``remove`` on taken out, wherever they
occur.

Copies of a text are no evidence. Contexts of an entity and a term are told apart by the
smallest hash of the words around the mention, which near copies share; their effective
number is two to the entropy of its distribution, and it has to reach ``least_contexts``.

Passes over the texts: one for the words near mentions, counted by (entity, term, context);
one that counts the terms with enough contexts everywhere; one that finds all spans. The
last two are left out where no term is in question. What the executors get of the terms is
a bit field of 16 MiB at most; an exact join removes what passes it by chance.

Defined results: a null text is empty and has no spans. Repeated rows are rows of their
own. doc_id is passed on as it is, null too. An empty table gives an empty result; other
columns are kept by ``sanitise`` and ignored by ``find``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import fresh, stage

#: Fixed values of the contract: the kinds in their order.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

TERM = re.compile(r"[^\W_]+")
GENERAL, REMOVE = "generalise", "remove"
FIELD_BITS = 1 << 27
TERMS_AT_ONCE = 200_000

SPAN = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("end", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Disclosure:
    """When terms give an entity away; see the module."""

    window: int = 8
    least_contexts: float = 3.0
    generalise: float = 0.85
    remove: float = 0.95


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        doubled = int(digit) * (1 + place % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ backwards, so that a long run without one is read once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in code points, ordered."""
    spans = [(start, 0, end) for start, end in _emails(text)]
    for match in ADDRESS.finditer(text):
        parts = [part.lstrip("0") or "0" for part in match.group().split(".")]
        if all(len(part) < 4 and int(part) < 256 for part in parts):
            spans.append((match.start(), 1, match.end()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((match.start(), 2, match.end()))
    for match in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, match.group())) <= 15:
            spans.append((match.start(), 3, match.end()))
    return sorted(spans)


def entity(kind: int, value: str) -> str:
    """The value a mention names, however it is written."""
    if kind == 0:
        return f"email:{value.lower()}"
    if kind == 1:
        return "ip:" + ".".join(part.lstrip("0") or "0" for part in value.split("."))
    return f"{KINDS[kind]}:{re.sub('[^0-9]', '', value)}"


def free_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, lower-cased term) of the words outside the base spans."""
    out, i, ends = [], 0, 0
    for match in TERM.finditer(text):
        start, end = match.span()
        while i < len(spans) and spans[i][0] < end:
            ends = max(ends, spans[i][2])
            i += 1
        if start >= ends:
            out.append((start, end, match.group().lower()))
    return out


def _term_hash(term: str) -> int:
    return crc32(term.encode())


def contexts(text: str, window: int) -> Iterator[tuple[str, str, int]]:
    """(entity, term, context) for every position near a mention, once for each entity."""
    spans = base_spans(text)
    if not spans:
        return
    terms = free_terms(text, spans)
    starts = np.array([start for start, _, _ in terms], dtype=np.int64)
    seen: set[tuple[str, int]] = set()
    for start, kind, end in spans:
        name = entity(kind, text[start:end])
        left, right = np.searchsorted(starts, [start, end])
        near = range(max(left - window, 0), min(right + window, len(terms)))
        hashes = sorted({_term_hash(terms[i][2]) for i in near})
        for i in near:
            if (name, i) not in seen:
                seen.add((name, i))
                own = _term_hash(terms[i][2])
                yield name, terms[i][2], next((h for h in hashes if h != own), own)


def _co_occurrences(texts: DataFrame, rule: Disclosure) -> DataFrame:
    """(entity, term, near, contexts): positions of the term near the entity, effective contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text in batch.column(0):
                counts.update(contexts(text.as_py() or "", rule.window))
            rows = list(zip(*counts, strict=True)) or [(), (), ()]
            types = (pa.string(), pa.string(), pa.int64())
            columns = [pa.array(column, kind) for column, kind in zip(rows, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(list(counts.values()), pa.int64())], names=["entity", "term", "context", "n"]
            )

    found = texts.select("text").mapInArrow(run, "entity string, term string, context long, n long")
    apart = found.groupBy("entity", "term", "context").agg(F.sum("n").alias("n"))
    near = F.sum("n")
    bits = F.log2(near) - F.sum(F.col("n") * F.log2("n")) / near
    return apart.groupBy("entity", "term").agg(near.alias("near"), F.pow(2.0, bits).alias("contexts"))


def _bit_field(terms: DataFrame) -> np.ndarray:
    """Which values of the terms' hashes occur, at most ``FIELD_BITS`` bits."""
    place = F.crc32(F.col("term").cast("binary")) % FIELD_BITS
    bits = terms.groupBy(F.shiftright(place, 6).alias("block")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(crc32(CAST(term AS BINARY)) % {FIELD_BITS} % 64 AS INT))")).alias("bits")
    )
    rows = bits.toArrow()
    field = np.zeros(FIELD_BITS // 64, dtype=np.uint64)
    field[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return field


def _marked(field: np.ndarray, terms: list[str]) -> np.ndarray:
    """Which of the terms may be among those of the field."""
    place = np.fromiter(map(_term_hash, terms), np.int64, len(terms)) % FIELD_BITS
    return (field[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def _occurrences(texts: DataFrame, shipped) -> DataFrame:
    """(term, n) of the terms in question outside base spans; the null term counts all."""

    def emit(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                words = Counter(term for _, _, term in free_terms(text, base_spans(text)))
                known = list(words)
                counts[None] += words.total()
                for i in np.flatnonzero(_marked(shipped.value, known)):
                    counts[known[i]] += words[known[i]]
                if len(counts) > TERMS_AT_ONCE:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    found = texts.select("text").mapInArrow(run, "term string, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(documents: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """(term, share, action): the terms that give away enough of an entity, the most over all entities."""
    spark = documents.sparkSession
    pairs = stage(_co_occurrences(documents, rule), "co-occurrences")
    asked = stage(pairs.where(F.col("contexts") >= rule.least_contexts), "asked")
    terms = asked.select("term").distinct()
    if terms.isEmpty():
        return spark.createDataFrame([], "term string, share double, action string")
    shipped = spark.sparkContext.broadcast(_bit_field(terms))
    counted = stage(_occurrences(documents, shipped), "occurrences")
    shipped.unpersist()
    everywhere = counted.where("term IS NULL").agg(F.sum("n")).first()[0]
    whole = pairs.groupBy("entity").agg(F.sum("near").alias("entity_near"))
    content = -F.log2(F.col("entity_near") / everywhere)
    given = F.log2(F.col("near") / F.col("n"))
    measured = (
        asked.join(counted, "term")
        .join(whole, "entity")
        .where(F.col("entity_near") < everywhere)
        .groupBy("term")
        .agg(F.max(1 + given / content).alias("share"))
    )
    action = F.when(F.col("share") >= rule.remove, REMOVE).otherwise(GENERAL)
    return stage(measured.where(F.col("share") >= rule.generalise).withColumn("action", action), "terms")


def find(documents: DataFrame, rule: Disclosure = Disclosure(), carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``carry``, then ``base`` and ``spans``, arrays of (start, turn, kind, end)."""
    spark = documents.sparkSession
    terms = disclosing_terms(documents, rule)
    shipped = None if terms.isEmpty() else spark.sparkContext.broadcast(_bit_field(terms))
    rows = documents.select(*carry, F.col("text").alias("text_of_it"))
    maybe = T.StructType(
        [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("term", T.StringType())]
    )
    schema = T.StructType(
        [
            *rows.schema.fields[:-1],
            T.StructField("base", T.ArrayType(SPAN)),
            T.StructField("maybe", T.ArrayType(maybe)),
        ]
    )
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("turn", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))
    arrow_maybe = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, others = [], []
            for text in batch.column(len(carry)):
                text = text.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": a, "turn": k, "kind": KINDS[k], "end": b} for a, k, b in spans])
                here = free_terms(text, spans) if shipped else []
                marked = np.flatnonzero(_marked(shipped.value, [term for _, _, term in here])) if here else []
                others.append([dict(zip(("start", "end", "term"), here[i], strict=True)) for i in marked])
            columns = [*batch.columns[: len(carry)], pa.array(base, arrow), pa.array(others, arrow_maybe)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = rows.mapInArrow(run, schema)
    if shipped is None:
        return found.select(*carry, "base", F.col("base").alias("spans"))
    found = stage(found.withColumn("row_of_it", F.monotonically_increasing_id()), "spans")
    each = found.where(F.size("maybe") > 0).select("row_of_it", F.explode("maybe").alias("at"))
    span = F.struct(
        F.col("at.start").alias("start"),
        F.lit(len(KINDS)).alias("turn"),
        F.col("action").alias("kind"),
        F.col("at.end").alias("end"),
    )
    added = each.join(terms, F.col("at.term") == F.col("term")).groupBy("row_of_it").agg(
        F.collect_list(span).alias("added")  # of one document
    )
    both = F.array_sort(F.concat("base", F.coalesce("added", F.lit([]).cast(T.ArrayType(SPAN)))))
    return found.join(added, "row_of_it", "left").select(*carry, "base", both.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _general(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitise(documents: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The documents with their texts sanitised: entities by kind, terms generalised or removed.

    Overlapping spans become one, named after the first. Rows and columns stay; a null text
    stays null.
    """
    plain = [f"c{i}" for i in range(len(documents.columns))]
    place = documents.columns.index("text")
    rows = documents.toDF(*plain).withColumn("text", F.col(plain[place]))
    found = find(rows, rule, tuple(plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(len(plain)).to_pylist(), strict=True):
                parts, done = [], 0
                for span in spans or []:
                    start, end = span["start"], span["end"]
                    if start >= done:
                        parts.append(text[done:start])
                        if span["kind"] == GENERAL:
                            parts.append(_general(text[start:end]))
                        elif span["kind"] != REMOVE:
                            parts.append(f"[{span['kind'].upper()}]")
                    done = max(done, end)
                texts.append(text if text is None else "".join(parts) + text[done:])
            columns = list(batch.columns[: len(plain)])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=plain)

    return found.select(*plain, "spans").mapInArrow(run, rows.select(*plain).schema).toDF(*documents.columns)
