"""The corpus pipeline: documents in, token ids out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, unused
from cellweave.llm.jaccard_join import jaccard_components
from cellweave.llm.line_dedup import line_dedup
from cellweave.llm.mixing import mix_sources
from cellweave.llm.quality import quality_classifier
from cellweave.llm.queries import piece_model
from cellweave.llm.sentencepiece_codec import encode_documents

#: SQL can't express the classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def columns_of(docs: DataFrame) -> list[str]:
    """The columns' names in quotes, so that any name will do."""
    return [f"`{c}`" for c in docs.columns]


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with every column but those that a stage uses under a name that no operator knows, and the columns as they were."""
    names = {c: c if c in used else f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; other columns keep their values, also those named as the classifier's."""
    renamed, back = aside(docs, "doc_id", "text", "lang", "source", "n_chars")
    scored = quality_classifier(renamed, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("quality_keep").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; ``n_chars`` follows. Every document stays, if with an empty text; other columns keep their values, whatever their names."""
    renamed, back = aside(docs, "doc_id", "text", "n_chars")
    cut = line_dedup(renamed)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[n_chars.alias("n_chars") if c == "n_chars" else b for c, b in zip(docs.columns, back, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links (five words, 0.8) connect, the one with the smallest id stays."""
    found = jaccard_components(docs, words=5, percent=80)
    gone = materialize(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words, which counts nowhere, once."""
    id_, passes, copy = unused(docs.columns, "id", "passes", "copy")
    most = F.max(F.when(F.col("size") > 0, F.col("passes")).otherwise(1)).alias(passes)
    taken = materialize(mix_sources(docs).groupBy(F.col("doc_id").alias(id_)).agg(most), "taken")
    rows = docs.join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_))).where(F.col(passes) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), passes))).select(*columns_of(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return encode_documents(docs, piece_model(), spans=False).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
