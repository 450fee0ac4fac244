"""Importance resampling towards the word use of a target, with long texts cut into overlapping chunks."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

#: A word, in UTF-8: ASCII digits and small letters, and every byte beyond ASCII.
FEATURE_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Texts of more bytes are cut into chunks that own so many starting positions each.
LONG_BYTES, CHUNK_WORDS = 1 << 15, 4096


def _hashes(words: list[bytes], owned: int, longest: int) -> np.ndarray:
    """CRC-32 of all runs of 1 to ``longest`` words that start at the first ``owned`` ones. A run's CRC carries on that of the run without its last word."""
    crc, out = list(map(zlib.crc32, words[:owned])), []
    spaced = [b" " + w for w in words]
    for n in range(1, longest + 1):
        out.append(crc)
        crc = list(map(zlib.crc32, spaced[n:], crc))
    return np.array([x for part in out for x in part], np.int64)


def _cut(longest: int):
    """Chunks of whole words: each owns the runs that start at its first ``owned`` words and carries ``longest - 1`` words of the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, of, text in zip(*batch.columns, strict=True):
                words = FEATURE_WORD.findall(text.as_py().lower())
                at = range(0, len(words), CHUNK_WORDS) or range(1)
                rows = [b" ".join(words[i : i + CHUNK_WORDS + longest - 1]) for i in at]
                n = len(rows)
                owned = [min(CHUNK_WORDS, len(words) - i) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([id_.as_py()] * n, batch.column(0).type), pa.array([of.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(rows, pa.binary()), pa.array(owned, pa.int32())], ["doc_id", "of", "chunk", "text", "owned"])

    return cut


def _chunks(texts: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, of, chunk, text, owned``: short texts as they are (chunk and owned null), and long ones cut and dealt out, so that one text may fill many tasks."""
    long = F.octet_length("text") > LONG_BYTES
    kinds = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, of long, chunk int, text binary, owned int"
    cut = materialize(texts.where(long).mapInArrow(_cut(longest), kinds).repartition("doc_id", "of", "chunk"), "chunks")
    return texts.where(~long).select("doc_id", "of", F.lit(None).cast("int").alias("chunk"), "text", F.lit(None).cast("int").alias("owned")), cut


def _histogram(chunks: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket: a row per bucket and task travels, and ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text, owned in zip(*batch.columns, strict=True):
                words = FEATURE_WORD.findall(text.as_py().lower())
                total += np.bincount(_hashes(words, owned.as_py() or len(words), longest) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in chunks.select("text", "owned").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, a bucket each."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum() + len(corpus)), float(target.sum() + len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64).reshape(n)


def _weighed(chunks: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """Words, features and gains of each chunk."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for i, (text, owned) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                words = FEATURE_WORD.findall(text.as_py().lower())
                mine = owned.as_py() or len(words)
                found = _hashes(words, mine, longest) % len(gain)
                rows[:, i] = mine, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, rows)], ["doc_id", "of", "chunk", "n_words", "n_features", "gain"])

    id_type = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.mapInArrow(weigh, f"doc_id {id_type}, of long, chunk int, n_words long, n_features long, gain long")


def _noise(id_: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that the id alone decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rank`` by falling score, ties to the smaller id, over all rows: rows are dealt to ranges and written, ranks within a range go on from the ranges before."""
    dealt = materialize(rows.repartitionByRange(F.desc("score"), "doc_id").withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("score"), "doc_id"))
    return dealt.withColumn("_i", inside).join(F.broadcast(sizes.select("_p", before.alias("_before"))), "_p").select(*rows.columns, (F.col("_before") + F.col("_i")).alias("rank"))


def importance_resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 2, buckets: int = 10_000, min_words: int = 20, percent: int = 25, seed: int = 7
) -> DataFrame:
    """Draws the share of documents whose hashed features look most like the target's, with Gumbel noise, without replacement.

    Features are runs of 1 to ``longest`` lower-cased words, hashed into ``buckets``. One pass counts the buckets of all of ``docs``
    and of ``target``, a second one averages the buckets' gains over each document. A text of more than ``LONG_BYTES`` is
    cut at word boundaries into chunks that carry ``longest - 1`` words of the next one and own their starting positions, so
    every run is counted once; chunks are dealt out over tasks, and their counts and gains are summed by document.
    The histograms, of ``buckets`` rows, are all that reaches the driver or is sent to tasks.

    Null and empty texts, and those without words, have weight 0 and are never drawn; rows that repeat id and text get the
    same score, and ranks in any order; a null id draws noise as an empty one and is the smallest of a tie; an empty table gives no rows,
    an empty target smoothed shares only. Other columns are ignored, whatever their names.

    Returns ``doc_id, n_features, weight, score, rank, n_words``; ``rank`` is null where not drawn.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    short, cut = _chunks(docs.select(docs[f"`{id_col}`"].alias("doc_id"), F.xxhash64(text).alias("of"), text.cast("binary").alias("text")), longest)
    wanted = F.coalesce(target[f"`{target_col}`"], F.lit(""))
    aims = _chunks(target.select(F.lit(0).alias("doc_id"), F.xxhash64(wanted).alias("of"), wanted.cast("binary").alias("text")), longest)
    gain = gains(_histogram(short.unionByName(cut), longest, buckets), _histogram(aims[0].unionByName(aims[1]), longest, buckets))

    sums = ["n_words", "n_features", "gain"]
    each = _weighed(cut, gain, longest).groupBy("doc_id", "of", "chunk").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in sums])  # rows that repeat id and text
    long = each.groupBy("doc_id", "of").agg(F.max("copies").cast("int").alias("copies"), *[F.sum(c).alias(c) for c in sums])
    long = long.select("doc_id", *sums, F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    whole = _weighed(short, gain, longest).select("doc_id", *sums).unionByName(long)
    n, total = F.col("n_features"), F.col("gain")
    weight = F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))
    scored = whole.select("doc_id", "n_features", weight.alias("weight"), (weight + _noise(F.col("doc_id"), seed)).alias("score"), "n_words")
    scored = materialize(scored, "scores")

    eligible = F.col("n_words") >= min_words
    k = scored.where(eligible).count() * percent // 100
    ranked = _ranked(scored.where(eligible)).withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
