"""Line deduplication by winnowing over line hashes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import WORD, discard, materialize, unused

#: Second hash of a window beside its 64-bit one.
SALT = 0x5BD1E995
PLACES = "array<int>"
WINDOWS = "array<struct<start:int,size:int,key:bigint,key2:bigint,at:array<int>,words:int>>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda a, x: a + x["words"])


def _minima(size: int, min_lines: int, min_words: int) -> Column:
    """The places of the smallest line hash of each window of ``size`` lines that counts."""

    def smallest(i: Column) -> Column:
        part = F.slice("lines", i, size)
        hashes = F.transform(part, lambda x: x["h"])
        place = (i + F.array_position(hashes, F.array_min(hashes)).cast("int") - 1).cast("int")
        return place if size == min_lines else F.when(_words(part) >= min_words, place)

    count = F.size("lines") - (size - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), smallest)).otherwise(F.array().cast(PLACES))


def _extended(size: int, min_lines: int, min_words: int) -> Column:
    """The windows of ``size`` lines around ``places`` that count, with two hashes of the whole."""

    def around(p: Column) -> Column:
        low, high = F.greatest(F.lit(1), p - (size - 1)), F.least(p, F.size("lines") - (size - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast(PLACES))

    def window(i: Column) -> Column:
        part = F.slice("lines", i, size)
        return F.struct(
            i.alias("start"),
            F.lit(size).alias("size"),
            F.xxhash64(F.transform(part, lambda x: x["h"])).alias("key"),
            F.xxhash64(F.transform(part, lambda x: x["g"]), F.lit(size)).alias("key2"),
            F.transform(part, lambda x: x["at"]).alias("at"),
            _words(part).alias("words"),
        )

    every = F.transform(F.array_distinct(F.flatten(F.transform("places", around))), window).cast(WINDOWS)
    return every if size == min_lines else F.filter(every, lambda x: x["words"] >= min_words)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int = 50) -> DataFrame:
    """Deletes each line in a run of lines that also starts earlier, in a smaller id or earlier in the same text.

    A run counts if it has ``min_lines`` lines, or fewer but ``min_words`` words; it is judged on the input. Blank
    lines lie outside of runs and stay. Every window of so many lines selects the place of its smallest line hash as
    fingerprint, so equal runs are sure to share one, and only the selected places leave their texts. Fingerprints that
    occur at one place only are dropped; the places of the others are joined back to their texts' lines and extended to both sides,
    as far as a window reaches. The windows there are compared with the first of their kind by a 128-bit hash of their lines, not by
    their bytes; later ones mark their lines, overlapping marks add up to the whole repeated run, and marked lines go.

    Counts and first positions are partial aggregates before they travel, so a run in a third of all documents is one
    row per task; joins on hot keys are between written tables, which adaptive execution splits. The texts are read twice
    and shuffled once. Null and empty texts stay as they are; rows that repeat both id and text are one document, whose
    copies get the same result; ids must be whole numbers, null ones count as smallest; an empty table gives no rows. All columns stay, whatever their names.

    Returns the columns of ``docs`` with the new text, then ``n_lines`` and ``n_removed``. Columns of these names are replaced.
    """
    docs = docs.drop(*[c for c in ("n_lines", "n_removed") if c in docs.columns and c not in (id_col, text_col)])
    text = docs[f"`{text_col}`"]
    id_, of = F.coalesce(docs[f"`{id_col}`"].cast("long"), F.lit(-(2**63))), F.xxhash64(text)
    line = lambda x, i: F.struct((i + 1).alias("at"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(SALT)).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("words"))
    hashed = materialize(docs.select(id_.alias("id"), of.alias("of"), F.filter(F.transform(_lines(text), line), lambda x: x["words"] > 0).alias("lines")).where(F.size("lines") > 0), "lines")
    sizes = range(1, min_lines + 1)
    chosen = F.array_compact(F.array_distinct(F.concat(*[_minima(n, min_lines, min_words) for n in sizes])))
    places = hashed.select("id", "of", F.explode(F.transform(chosen, lambda p: F.struct(p.alias("place"), F.element_at("lines", p)["h"].alias("print")))).alias("p")).select("id", "of", "p.*")

    place = F.xxhash64("id", "of", "place")
    shared = materialize(places.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("print"), "shared")
    # The sides of these joins grow with the documents, so they're never broadcast.
    joined = places.join(shared.hint("merge"), "print").groupBy("id", "of").agg(F.collect_set("place").alias("places"))
    windows = hashed.join(joined.hint("merge"), ["id", "of"]).select("id", "of", F.explode(F.concat(*[_extended(n, min_lines, min_words) for n in sizes])).alias("w"))
    found = materialize(windows.select("id", "of", "w.start", "w.size", "w.key", "w.key2", "w.at"), "windows")
    discard(hashed)
    discard(shared)

    same = ["size", "key", "key2"]
    first = found.groupBy(*same).agg(F.min(F.struct("id", "of", "start")).alias("first"), F.max(F.struct("id", "of", "start")).alias("last")).where("first < last")
    first = materialize(first.drop("last"), "first")
    later = found.join(first.hint("merge"), same).where(F.struct("id", "of", "start") > F.col("first"))
    id_name, of_name, gone, lines = unused(docs.columns, "id", "of", "gone", "lines")
    marked = later.select(F.col("id").alias(id_name), F.col("of").alias(of_name), F.explode("at").alias("at")).groupBy(id_name, of_name).agg(F.collect_set("at").alias(gone))
    marked = materialize(marked, "marked")
    discard(found)
    discard(first)

    both = docs.withColumns({id_name: id_, of_name: of}).join(marked.hint("merge"), [id_name, of_name], "left").withColumn(lines, _lines(F.col(f"`{text_col}`")))
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)  # a hash set, in order
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i)), "\n")
    columns = [(F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(rest) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return both.select(
        *columns,
        F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )
