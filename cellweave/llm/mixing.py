"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, n_words

#: A document's place in its source is a hash of so many bits, refined so many at a time.
HASH_BITS, LEVEL_BITS = 60, 10
#: Rows of a source table that may be broadcast; beyond it the joins shuffle.
BROADCAST_ROWS = 100_000


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, cap: float) -> dict[str | None, float]:
    """Words to take from each source. Sources in code point order, null last, get ``weights`` in turn."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: cap * n for s, n in order}
    left, active, out = share * sum(n for _, n in order), list(weight), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > limit[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = float(limit[s])
            left -= limit[s]
        active = [s for s in active if s not in out]
    return out


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Chooses how often each document enters a mix in which sources have the given weights.

    Sizes are words. A source's target is split into whole passes over it and a rest; the rest is met by the documents
    whose hash is below the source's threshold. Thresholds come from nested histograms: sizes summed by source
    and by the next ``LEVEL_BITS`` bits of the hash show in which bucket the budget ends, and only that bucket is read on,
    until it holds one document, which enters if that brings the source nearer to its target. Nothing is sorted,
    the choice depends only on ids, and reruns agree. Histograms are partial sums before they travel, so a source with
    a third of all rows costs no more than another. One row per source reaches the driver.

    Null texts have size 0, a null source is a source of its own, rows of equal id stand or fall together, an empty table
    gives no rows. ``cap`` is a whole number of passes. Other columns are ignored.

    Returns ``doc_id, size, source_size, target, taken, passes``; ``taken`` is ``passes * size``.
    """
    spark = docs.sparkSession
    place = F.conv(F.substring(F.md5(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = materialize(docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{source_col}`"].alias("source"), n_words(docs[f"`{text_col}`"]).alias("size"), place.alias("place")), "sizes")
    per_source = [(r["source"], r["size"]) for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    target = targets(per_source, weights, share, cap)

    # state: source -> [passes, words left to find, first bits of the threshold]; done: source -> [passes, threshold]
    state, done = {}, {}
    for s, n in per_source:
        passes = min(int(target[s] // n), int(cap)) if n else 0
        state[s] = [passes, target[s] - passes * n, 0]
    small = F.broadcast if len(per_source) <= BROADCAST_ROWS else lambda df: df
    kinds = "source string, first long, rest double"
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        if not state:
            break
        shift = HASH_BITS - LEVEL_BITS * level
        open_ = spark.createDataFrame([(s, x[2], float(x[1])) for s, x in state.items()], kinds)
        bits = F.shiftright("place", shift)
        inside = sized.join(small(open_), sized["source"].eqNullSafe(open_["source"]) & (F.shiftright(bits, LEVEL_BITS) == open_["first"]))
        histogram = inside.groupBy(open_["source"], "rest", bits.alias("bucket")).agg(F.sum("size").alias("size"), (F.min("place") == F.max("place")).alias("single"))
        before = F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")
        ends = histogram.withColumn("before", before).where("size > 0 and before + size > rest and before <= rest")
        found = {r["source"]: r for r in ends.collect()}
        for s, (passes, rest, _) in list(state.items()):
            r = found.get(s)
            if r is None:  # the rest is 0 words of an empty source, or rounding left just above all of them
                done[s] = [passes, (state[s][2] + 1) * 2 ** (shift + LEVEL_BITS) - 1 if rest > 0 else -1]
                del state[s]
            elif r["single"] or not shift:
                enters = 2 * (rest - r["before"]) >= r["size"]
                done[s] = [passes, (r["bucket"] + enters) * 2**shift - 1]
                del state[s]
            else:
                state[s] = [passes, rest - r["before"], r["bucket"]]

    plan = spark.createDataFrame(
        [(s, n, float(target[s]), *done[s]) for s, n in per_source], "source string, source_size long, target double, whole int, threshold long"
    )
    passes = F.col("whole") + F.when(F.col("place") <= F.col("threshold"), 1).otherwise(0)
    return sized.join(small(plan), sized["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "size", "source_size", "target", (passes * F.col("size")).cast("long").alias("taken"), passes.cast("int").alias("passes")
    )
