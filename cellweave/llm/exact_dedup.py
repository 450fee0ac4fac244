"""Exact deduplication by tree-merged sorted runs of digests."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import ascii_lower, materialize

#: Digests that a stretch of the digest space holds on average once all runs are merged.
STRETCH_ROWS = 4096
#: Entries in a run: digest, byte length, largest id, its row, and how many rows. A null id ranks below all others.
ENTRY = ["digest", "n_bytes", "doc_id", "row", "n"]


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs of entries; entries of one digest, verified by their byte length, leave one with the largest id."""
    for (digest, n_bytes), same in itertools.groupby(heapq.merge(*runs, key=lambda e: e[:2]), key=lambda e: e[:2]):
        held = list(same)  # one from each run at most
        best = max(held, key=lambda e: (e[2] is not None, e[2] if e[2] is not None else 0, e[3]))
        yield digest, n_bytes, best[2], best[3], sum(e[4] for e in held)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """Groups rows whose texts are identical after lower-casing A-Z; the row with the largest id stays.

    Each input partition becomes a run, sorted by digest, in which equal digests of equal byte length shrink to one entry
    (largest id, count); the two must agree for texts to count as equal. The digest space is cut into equal stretches, so
    that a run travels in pieces of bounded size, and runs merge in binomial rounds: in every round ``fan_in`` neighbouring
    runs of a stretch meet in a task, a heap merges them in one pass, and equal entries leave the verified largest
    id. A text that fills a third of the table is one entry per run before the first exchange and never more than ``fan_in`` entries
    afterwards. Only digests travel; the texts are read once. Digests and survivors are written to the shared folder, so the
    last join starts from two plain tables whose hot digests adaptive execution can split.

    Null texts count as empty, empty texts form a group, long texts are hashed whole. Null ids rank below all others.
    Of rows that repeat both id and text one is kept. An empty table gives no rows. Other columns are ignored.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.
    """
    norm = ascii_lower(docs[f"`{text_col}`"]).cast("binary")
    digests = docs.select(
        docs[f"`{id_col}`"].alias("doc_id"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.octet_length(norm).cast("long").alias("n_bytes"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    digests = materialize(digests, "digests")
    id_type = digests.schema["doc_id"].dataType.simpleString()
    last, count = digests.agg(F.coalesce(F.max("run"), F.lit(0)), F.count(F.lit(1))).first()
    bits = min(31, max(0, (count // STRETCH_ROWS).bit_length()))
    stretch = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits).cast("int")
    # Spark sorts a partition, whose pieces are the runs of its stretches; the aggregate before it leaves one entry for each digest.
    entries = digests.groupBy("run", "digest", "n_bytes").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")).select(stretch.alias("stretch"), "run", "digest", "n_bytes", "keep.doc_id", "keep.row", "n")
    entry = f"struct<digest:binary,n_bytes:bigint,doc_id:{id_type},row:bigint,n:bigint>"
    runs = entries.groupBy("stretch", "run").agg(F.array_sort(F.collect_list(F.struct(*ENTRY))).alias("entries"))
    while last:
        last //= fan_in
        grouped = runs.select("stretch", F.floor(F.col("run") / fan_in).cast("int").alias("run"), "entries").repartition("stretch", "run").sortWithinPartitions("stretch", "run")
        runs = grouped.mapInArrow(_merge, f"stretch int, run int, entries array<{entry}>")
    survivors = materialize(runs.select(F.explode("entries").alias("e")).select("e.digest", "e.n_bytes", F.col("e.doc_id").alias("keep_id"), F.col("e.row").alias("keep_row"), F.col("e.n").alias("group_size")), "survivors")
    return digests.drop("run").join(survivors.hint("merge"), ["digest", "n_bytes"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each stretch and group that a task gets, in order of these, as one run."""
    rows = (r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
    kind = None
    for (stretch, run), group in itertools.groupby(rows, key=lambda r: r[:2]):
        held = [r[2] for r in group]
        kind = kind or held[0].type
        entries = list(merged([(tuple(e[c] for c in ENTRY) for e in h.as_py()) for h in held]))
        yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int32()), pa.array([run], pa.int32()), pa.array([[dict(zip(ENTRY, e, strict=True)) for e in entries]], kind)], ["stretch", "run", "entries"])

