"""Every stage of the pipeline against a plain version, on its own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_text_operators import frame, plain_components, texts

from cellweave.llm import suffix_dedup
from cellweave.llm.mixing import mix_sources
from cellweave.llm.sentencepiece_codec import load_codec


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages][2] == "n-gram Jaccard join"
    quality, lines, near, mix, encode = stages.values()

    kept = quality(spark, docs, sf_dir).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i, q in labels.items() if q]
    assert kept.columns == docs.columns
    assert sum(i in ids for i in good) >= 0.97 * len(good)
    assert sum(i not in ids for i, q in labels.items() if not q) >= 0.7 * (len(labels) - len(good))

    cut = lines(spark, kept, sf_dir).cache()
    assert cut.columns == docs.columns
    before = {r.doc_id: r for r in kept.collect()}
    for r in cut.collect():
        assert not Counter(r.text.split("\n")) - Counter(before[r.doc_id].text.split("\n")) - Counter([""])
        assert r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text))

    single = near(spark, cut, sf_dir).cache()
    plain = plain_components([(r.doc_id, r.text) for r in cut.collect()], 5, 80)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in plain.items() if i == c)

    mixed = mix(spark, single, sf_dir).cache()
    passes = {r.doc_id: r.passes if r["size"] else 1 for r in mix_sources(single).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in passes.items() if n})

    codec = load_codec(corpus_pipeline.piece_model())
    text = {r.doc_id: r.text for r in single.collect()}
    for r in encode(spark, mixed, sf_dir).collect():
        assert r.ids == codec.lib.encode(text[r.doc_id], add_bos=True, add_eos=True)


def test_run_on_awkward_rows(spark, sf_dir, tmp_path):
    frame(spark, texts()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {1, 3, 7, 9} & {r.doc_id for r in got}
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_columns_named_as_theirs(spark, sf_dir):
    names = ["n_removed", "n_lines", "quality_keep", "quality_score", "component_id", "passes", "size", "_column_0", "odd.name"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    docs = docs.select("*", *[(F.col("doc_id") * 10 + k).alias(n) for k, n in enumerate(names)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [r.doc_id * 10 + k for k in range(len(names))]


def test_quoted_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    odd = docs.withColumnsRenamed({"doc_id": "d.id", "text": "a text"})
    plain = suffix_dedup.substring_dedup(docs).collect()
    assert sorted(suffix_dedup.substring_dedup(odd, id_col="d.id", text_col="a text").collect()) == sorted(plain)
