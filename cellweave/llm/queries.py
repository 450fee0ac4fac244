"""The queries over the operators of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import shared_path
from cellweave.llm.exact_dedup import exact_dedup
from cellweave.llm.filter_audit import filter_audit
from cellweave.llm.jaccard_join import jaccard_components
from cellweave.llm.langid import identify_language
from cellweave.llm.line_dedup import line_dedup
from cellweave.llm.mixing import mix_sources
from cellweave.llm.passage_dedup import passage_dedup
from cellweave.llm.quality import quality_classifier
from cellweave.llm.resampling import importance_resample
from cellweave.llm.sentencepiece_codec import encode_documents
from cellweave.llm.suffix_dedup import substring_dedup
from cellweave.llm.topk import exact_top_k
from cellweave.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir), words=3, percent=90)


@query
def op2_warc(spark, sf_dir):
    path = shared_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archives(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


# DuckDB has no base32 and no SHA-1 of bytes, so the digest is spelled from hexadecimal groups of 5 bits.
ORACLE_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h) AS n, from_hex(sha1(h))::BIT::VARCHAR AS bits FROM p),
d AS (SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + substr(bits, 5 * i + 1, 5)::BIT::INTEGER, 1)), 'string_agg', '') AS digest FROM b)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY digest)
"""


@query
def op3_quality(spark, sf_dir):
    scored = quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "quality_text", "quality_meta", "quality_score", F.col("quality_keep").alias("kept"))


@query
def op4_line_dedup(spark, sf_dir):
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL["op4_line_dedup"] = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), b AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l
), n AS (
    SELECT doc_id, pos, line, words, lead(line, 1) OVER w AS line2, lead(words, 1) OVER w AS words2, lead(pos, 1) OVER w AS pos2,
           lead(line, 2) OVER w AS line3, lead(pos, 2) OVER w AS pos3
    FROM b WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), r AS (
    SELECT doc_id, pos, [pos] AS places, [line] AS lines FROM n WHERE words >= 50
    UNION ALL SELECT doc_id, pos, [pos, pos2], [line, line2] FROM n WHERE line2 IS NOT NULL AND words + words2 >= 50
    UNION ALL SELECT doc_id, pos, [pos, pos2, pos3], [line, line2, line3] FROM n WHERE line3 IS NOT NULL
), f AS (
    SELECT doc_id, places, row_number() OVER (PARTITION BY lines ORDER BY doc_id, pos) AS k FROM r
), g AS (SELECT DISTINCT doc_id, unnest(places) AS pos FROM f WHERE k > 1),
k AS (
    SELECT doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (g.pos IS NULL), '') AS kept
    FROM l LEFT JOIN g USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


@query
def op5_suffix_dedup(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir))


@query
def op6_exact_top_k(spark, sf_dir):
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL["op6_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op7_sentencepiece(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir), piece_model(), digests=True)


@query
def op8_language_id(spark, sf_dir):
    return identify_language(documents(spark, sf_dir))


@query
def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL["op9_exact_dedup"] = """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""


@query
def op10_mix_sources(spark, sf_dir):
    return mix_sources(documents(spark, sf_dir))


ORACLE_SQL["op10_mix_sources"] = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS place
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), r AS (  -- the sources that reach twice their size first
    SELECT *, 2 * n / w AS reach, sum(2 * n) OVER o AS capped, sum(w) OVER () - sum(w) OVER o AS others, 1.5 * sum(n) OVER () AS total
    FROM s WINDOW o AS (ORDER BY 2 * n / w, source NULLS LAST)
), u AS (  -- words for each unit of weight once the sources up to here are full
    SELECT max(unit) AS unit FROM (
        SELECT (total - capped) / others AS unit FROM r WHERE others > 0
        UNION ALL SELECT 1.5 * sum(n) / sum(w) FROM s)
), t AS (
    SELECT source, n, CASE WHEN 2 * n <= unit * w THEN 2.0 * n ELSE unit * w END::DOUBLE AS target FROM s, u
), p AS (
    SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t
), c AS (
    SELECT d.doc_id, d.size, p.n AS source_size, p.target, p.whole, p.target - p.whole * p.n AS rest, p.source,
           sum(d.size) OVER (PARTITION BY p.source ORDER BY d.place) AS upto
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (whole + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END)::INTEGER AS passes
FROM c
"""


@query
def op11_importance_resampling(spark, sf_dir):
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


# DuckDB has no CRC-32; it is folded over the bytes of each distinct feature, its table of 256 entries made by the rule.
ORACLE_SQL["op11_importance_resampling"] = r"""
WITH RECURSIVE e AS (
    SELECT i AS n, i AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM e WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS tab FROM e WHERE k = 8),
w AS (
    SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
    UNION ALL
    SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), f AS (
    SELECT side, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM w
), u AS (
    SELECT side, doc_id, feature, count(*) AS n FROM f GROUP BY ALL
), h AS (
    SELECT feature, xor(list_reduce(list_transform(range(0, strlen(feature)), lambda i: ('0x' || substr(hex(feature), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM u), crc
), b AS (
    SELECT i AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
    FROM range(10000) r(i) LEFT JOIN (SELECT side, bucket, n FROM u JOIN h USING (feature)) x ON x.bucket = i GROUP BY 1
), g AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM b
), d AS (
    SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM u JOIN h USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id
), s AS (
    SELECT w.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM w LEFT JOIN d ON d.doc_id = w.doc_id WHERE side = 'd'
), r AS (
    SELECT doc_id, n_features, weight, score, words >= 20 AS fit, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k, 25 * count(*) OVER (PARTITION BY words >= 20) // 100 AS drawn FROM s
)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND k <= drawn THEN k END AS rank FROM r
"""


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_SQL["op12_filter_audit"] = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
    FROM documents
), m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
           || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 'C' ELSE '' END
           || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
    FROM t LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, left(filter_order, step - 1) AS before FROM o, range(1, 6) r(step)),
k AS (
    SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS mine, fails = f AS alone, len(translate(fails, before, '')) < len(fails) AS earlier
    FROM c, s
), y AS (
    SELECT part, filter_order, step, any_value(f) AS f, sum(CASE WHEN NOT mine AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mine AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN mine AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN mine AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mine AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM k GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM y
"""


@query
def op13_passage_dedup(spark, sf_dir):
    return passage_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op13_passage_dedup"] = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS pos FROM t),
g AS (SELECT doc_id, pos, md5(array_to_string(ws[pos:pos + 49], ' ')) AS win FROM p),
r AS (SELECT doc_id, pos, doc_id > min(doc_id) OVER (PARTITION BY win) AS again FROM g),
m AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM r WHERE again),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
k AS (
    SELECT doc_id, count(*) AS n_words, count(m.pos) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (m.pos IS NULL) AS kept
    FROM w LEFT JOIN m USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)
"""
