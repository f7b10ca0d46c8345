"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (
    host_rules,
    importance,
    jaccard_join,
    language_id,
    mixing,
    neighbours,
    packing,
    pii,
    quality_classifier,
    spelling,
    toxicity,
    url_filter,
    warc,
)
from larder.llm.common import id_share, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score; predicted from 0.5 on."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_classifier.classify_quality(documents, read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of similar documents it is in."""
    return jaccard_join.similar_components(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score; predicted from 0.7 on."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(documents, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select(
        "doc_id",
        (id_share(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and whether the rules keep it."""
    documents = read(spark, sf_dir, "documents")
    judged = host_rules.judge(documents.select("doc_id", "source", "text"), ["doc_id", "source"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens."""
    import public_tokenizers

    documents = read(spark, sf_dir, "documents")
    return packing.packed_digests(documents, public_tokenizers.path("byte_bpe_50k.json"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says."""
    pages = read(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    manifest = warc.write_archives(pages, folder)
    return warc.read_archives(manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the verdict on its URL."""
    judged = url_filter.judge(read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language its text is predicted to be in."""
    documents = read(spark, sf_dir, "documents")
    model = language_id.fit_languages(documents)
    return language_id.predict_languages(documents.select("doc_id", "text"), model).select(
        "doc_id", (id_share(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words the mixture takes of it."""
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), modulus=20, k=20)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's words, the drawn ones ranked."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with its form and root."""
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and the terms that give it away."""
    found = pii.find(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_jaccard": op2_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_host_rules": op4_host_rules,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_neighbours": op10_neighbours,
    "op11_importance": op11_importance,
    "op12_spelling": op12_spelling,
    "op13_pii": op13_pii,
    "pipeline": corpus_pipeline.run,
}

_WORD = r"[^\x20\x09-\x0D]+"

#: Steps of the CRC's table, and the CRC of the hexadecimal digits in column ``hex``, as CTE and expression.
_CRC_TABLE = """
        crc_table AS (
          SELECT list(list_reduce(list_prepend(i, range(8)),
                   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps
          FROM (SELECT unnest(range(256)) AS i)
        )"""
_CRC = """xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(0, len(hex) // 2), lambda i: ('0x' || hex[2 * i + 1 : 2 * i + 2])::BIGINT)),
            lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_jaccard": rf"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
          FROM words
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b
            ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
          SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * shared >= 90 * (p.n + q.n - shared)
        ), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (
          SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
        )
        SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op4_host_rules": rf"""
        WITH texts AS (
          SELECT doc_id, source, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
          FROM documents
        ), starts AS (
          SELECT doc_id, unnest(range(1, len(w) - 1)) AS i,
                 unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
          FROM texts WHERE len(w) >= 3
        ), twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM starts),
        covered AS (
          SELECT doc_id, count(DISTINCT p) AS n FROM
            (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE c > 1) GROUP BY doc_id
        ), counts AS (
          SELECT x.doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 coalesce(c.n, 0) AS n_repeat_words
          FROM texts x LEFT JOIN covered c ON c.doc_id = x.doc_id
        ), tested AS (
          SELECT *, CAST(10 * n_symbols > word_chars AS INT) AS f1, CAST(n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines AS INT) AS f2,
                 CAST(100 * n_repeat_words > 30 * n_words AS INT) AS f3,
                 CAST(word_chars > 15 * n_words OR word_chars < 2 * n_words AS INT) AS f4
          FROM counts
        ), hosts AS (
          SELECT source, count(*) AS n, unnest([1, 2, 3, 4]) AS rule, unnest([sum(f1), sum(f2), sum(f3), sum(f4)]) AS f
          FROM tested GROUP BY source
        ), means AS (
          SELECT rule, sum(f) / sum(n) AS m, sum(n) AS total, count(*) AS hosts FROM hosts GROUP BY rule
        ), priors AS (
          SELECT rule, m, least(greatest(m * (1 - m) /
                   greatest(sum(n * (f / n - m) ** 2) / any_value(total) - m * (1 - m) * any_value(hosts) / any_value(total), 1e-9)
                   - 1, 1.0), 10000.0) AS strength
          FROM hosts JOIN means USING (rule) GROUP BY rule, m
        ), verdicts AS (
          SELECT source, max((f + m * strength) / (n + strength)) AS worst FROM hosts JOIN priors USING (rule) GROUP BY source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                 AND worst <= 0.5 AND (worst < 0.01 OR f1 + f2 + f3 + f4 = 0) AS kept
        FROM tested t JOIN verdicts v ON v.source IS NOT DISTINCT FROM t.source
    """,
    "op6_warc": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
        ), last AS (
          SELECT body, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY body
        )
        SELECT p.page_id, p.n AS payload_bytes, sha1(p.body) AS payload_digest,
               CASE WHEN p.page_id < l.original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id < l.original THEN l.original END AS refers_to
        FROM p LEFT JOIN last l ON p.body = l.body AND p.n >= 1000
    """,
    "op11_importance": rf"""
        WITH {_CRC_TABLE.strip()}, found AS (
          SELECT doc_id, TRUE AS corpus, {_LOWER.format("coalesce(text, '')")} AS t FROM documents
          UNION ALL SELECT NULL, FALSE, {_LOWER.format("coalesce(text, '')")} FROM benchmark
        ), words AS (
          SELECT doc_id, corpus, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM found
        ), counts AS (SELECT doc_id, corpus, w, count(*) AS k FROM words GROUP BY ALL),
        spelled AS (SELECT w, hex(encode(w)) AS hex FROM (SELECT DISTINCT w FROM counts)),
        places AS (SELECT w, {_CRC} % 10000 AS bucket FROM spelled, crc_table),
        buckets AS (
          SELECT bucket, coalesce(sum(k) FILTER (WHERE corpus), 0) AS s, coalesce(sum(k) FILTER (WHERE NOT corpus), 0) AS t
          FROM counts JOIN places USING (w) GROUP BY bucket
        ), totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM buckets),
        gains AS (
          SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
          FROM buckets, totals
        ), weights AS (
          SELECT doc_id, sum(k)::BIGINT AS n_features, sum(k * gain)::BIGINT AS weight
          FROM counts JOIN places USING (w) JOIN gains USING (bucket) WHERE corpus GROUP BY doc_id
        ), noise AS (
          SELECT doc_id, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM documents
        ), scores AS (
          SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
          FROM noise LEFT JOIN weights USING (doc_id)
        ), able AS (
          SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
          FROM scores WHERE n_features >= 20
        )
        SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank
        FROM scores s LEFT JOIN able a ON a.doc_id = s.doc_id
    """,
    "op12_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE.strip()}, runs AS (
          SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents
        ), counts AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE length(w) >= 6 GROUP BY ALL),
        spelled AS (SELECT *, hex(encode(doc_id || ':' || w)) AS hex FROM counts),
        hashed AS (SELECT w, k, {_CRC} AS h FROM spelled, crc_table),
        altered AS (
          SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed
        ), words AS (SELECT word, sum(k)::BIGINT AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
        cuts AS (
          SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS short FROM
            (SELECT word, n, unnest(range(length(word))) AS i FROM words)
        ), holes AS (
          SELECT word, n, i, substr(word, 1, i) || '*' || substr(word, i + 2) AS hole FROM
            (SELECT word, n, unnest(range(length(word))) AS i FROM words)
        ), near AS (
          SELECT c.word, c.n, w.word AS other, w.n AS other_n FROM cuts c JOIN words w ON w.word = c.short
          UNION ALL SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON w.word = c.short
          UNION ALL SELECT a.word, a.n, b.word, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
        ), ranked AS (
          SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
                 row_number() OVER (PARTITION BY word ORDER BY other_n DESC, hex(encode(other))) AS place FROM near
        ), forms AS (
          SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
                 CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
          FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
        ), paths AS (
          SELECT word, word AS at FROM forms
          UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL
        ), ends AS (SELECT p.word, p.at AS root FROM paths p JOIN forms f ON f.word = p.at WHERE f.form IS NULL)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
    """,
}
