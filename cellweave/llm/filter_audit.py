"""How filters interact: what each removes, alone, after others and on average over all orders."""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize

LETTERS = "ABCDE"
BITS = {c: 1 << i for i, c in enumerate(LETTERS)}


def _steps() -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    out = []
    for order in map("".join, itertools.permutations(LETTERS)):
        out += [{"o": order, "s": i + 1, "f": BITS[c], "b": sum(BITS[x] for x in order[:i])} for i, c in enumerate(order)]
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``id, of, total, distinct``: words of each id and text, exploded, counted by word and then by document.

    Texts travel once, to where their words are counted, and rows that repeat id and text become one before; words, which are several times as
    large with their keys, don't travel.
    """
    one = texts.groupBy("id", "of").agg(F.first("text").alias("text"))
    words = one.select("id", "of", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    each = words.groupBy("id", "of", "word").agg(F.count("*").alias("n"))
    return each.groupBy("id", "of").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
    label_id: str = "doc_id",
    good_col: str = "quality",
    toxic_col: str = "toxic",
    min_words: int = 50,
    min_distinct: int = 65,
    max_capitals: int = 5,
    symbols: str = "#$%&*|",
) -> DataFrame:
    """Audits five filters, in all orders, in each part of the table.

    A: under ``min_words`` words. B: distinct words under ``min_distinct`` percent. C: ``[A-Z]`` over ``max_capitals`` percent of
    the characters. D: any of ``symbols``. E: the text of a smaller id. Words are exploded and aggregated by document and
    word, then by document; flags from the characters and of repeated texts are outer-joined to them by document, and
    each part's documents fall into 32 conditional counts by the set of filters that they fail (and as many of good and of toxic
    documents). All orders and steps follow from these counts, so no order reads the documents again.

    Null texts count as empty. Rows that repeat id and text are counted as often as they are there, and don't repeat each other
    (their id isn't smaller); rows of one id with different texts are told apart by the text's hash; a null id is neither smaller nor larger
    than another and has no label. Of several labels of one id, any that is 1 counts. A null part is the empty string. Other columns are ignored,
    whatever their names; an empty table gives no rows. A text in a third of all rows is one row per task where texts
    are compared, and the joins are between written tables, whose hot keys adaptive execution splits.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("of"), text.alias("text"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"))
    words = materialize(word_counts(texts), "words")

    capitals, marks = F.regexp_count("text", F.lit("[A-Z]")), "[" + "".join(f"\\x{{{ord(c):x}}}" for c in symbols) + "]"
    flags = texts.select(
        "id", "of", "part", F.sha2("text", 256).alias("sha"), (100 * capitals.cast("long") > max_capitals * F.length("text").cast("long")).alias("c"), F.col("text").rlike(marks).alias("d")
    ).groupBy("id", "of", "part", "sha", "c", "d").agg(F.count("*").alias("rows"))
    flags = materialize(flags, "flags")
    first = materialize(flags.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first"), "first")
    first_flags = flags.join(first.hint("merge"), "sha", "left").withColumn("e", F.coalesce(F.col("id") > F.col("first"), F.lit(False))).drop("sha", "first")

    label = labels.select(labels[f"`{label_id}`"].alias("label_id"), (labels[f"`{good_col}`"] == 1).alias("good"), (labels[f"`{toxic_col}`"] == 1).alias("toxic"))
    label = label.where("label_id is not null").groupBy("label_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("of") == F.col("of2"))
    words = words.withColumnsRenamed({"id": "id2", "of": "of2"})
    joined = first_flags.join(words.hint("merge"), same, "left")
    joined = joined.join(label.hint("merge"), F.col("id") == F.col("label_id"), "left")

    total = F.coalesce("total", F.lit(0))
    fails = {"A": total < min_words, "B": 100 * F.coalesce("distinct", F.lit(0)) < min_distinct * total, "C": F.col("c"), "D": F.col("d"), "E": F.col("e")}
    mask = sum((F.when(fails[c], BITS[c]).otherwise(0) for c in LETTERS), F.lit(0))
    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    rows = joined.select("part", "rows", mask.alias("mask"), *[v.alias(k) for k, v in kinds.items()])
    cells = [F.struct(F.lit(m).alias("mask"), *[F.coalesce(F.sum(F.when((F.col("mask") == m) & F.col(k), F.col("rows"))), F.lit(0)).alias(k) for k in kinds]) for m in range(1 << len(LETTERS))]
    counts = rows.groupBy("part").agg(F.array(*cells).alias("cells"))
    return _orders(counts)


def _orders(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from ``cells``, the counts by set of failed filters."""
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<o:string,s:int,f:int,b:int>>")
    at = counts.select("part", "cells", F.explode(steps).alias("at")).select("part", "cells", "at.*")
    f, before = F.col("f"), F.col("b")

    def total(test, value="n") -> Column:
        amount = value if callable(value) else lambda x: x[value]
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(test(x["mask"]), amount(x)).otherwise(0))

    def fair(x) -> Column:
        """In how many orders the filter is the first of those that the documents fail."""
        return x["n"] * F.element_at(F.array(*[F.lit(math.factorial(len(LETTERS)) // n) for n in range(1, len(LETTERS) + 1)]), F.bit_count(x["mask"]))

    mine, earlier = (lambda m: m.bitwiseAND(f) > 0), (lambda m: m.bitwiseAND(before) > 0)
    removed = lambda m: mine(m) & ~earlier(m)
    return at.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"),
        total(lambda m: ~mine(m) & ~earlier(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: mine(m) & earlier(m)).alias("redundant"), total(lambda m: m == f).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"), total(mine, fair).alias("shapley"),
    )
