"""The pipeline's stages on a small corpus with known answers, and the registered queries."""

import random

import pytest

import corpus_pipeline
from pixelframe.llm import queries
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(21), tmp_path_factory.mktemp("corpus")
    docs, labels = [], []
    for i in range(900):
        toxic, junk = i % 9 == 0, i % 9 == 1
        text = words(rng, 40)
        if toxic:
            text[5] = "scumbag"
        if junk:
            text = [w + "###" for w in text]
        docs.append((i, " ".join(text), "en", "s", 0, 1.5))
        labels.append((i, int(not junk), int(toxic)))
    clean = next(t for i, t, *_ in docs if i % 9 == 4)
    docs += [(2000, clean, "en", "s", 0, 1.5), (2001, clean + " end", "en", "s", 0, 1.5), (2002, clean, "en", "s", 0, 1.5), (2002, clean, "en", "s", 0, 1.5), (3000, None, None, None, None, None), (None, " ".join(words(rng, 40)), "en", "s", 0, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    ordinary = [i for i in range(900) if i % 9 > 1]
    assert not any(i is not None and i < 900 and i % 9 == 0 for i in kept["toxicity"])
    assert sum(i in set(kept["toxicity"]) for i in ordinary) >= 0.99 * len(ordinary)
    assert not any(i is not None and i < 900 and i % 9 <= 1 for i in kept["quality"])
    assert sum(i in set(kept["near_dedup"]) for i in ordinary) >= 0.98 * len(ordinary)
    assert not {2000, 2001, 2002} & set(kept["near_dedup"]) and None in kept["near_dedup"]
    assert len(kept["near_dedup"]) == len(set(kept["near_dedup"]))
    packed = docs.groupBy("doc_id").sum("length").join(docs.select("doc_id", "doc_tokens").distinct(), "doc_id")
    assert packed.where("`sum(length)` <> doc_tokens").count() == 0
    assert corpus_pipeline.run(spark, corpus).count() == docs.count()


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables, no labels, texts that are null, empty, very long or repeated, and columns whose names the stages use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node long, raw string, t1 long, component_id string, _k0 long, bucket int"
    extra = (None, None, None, 1, "r", 2, "c", 3, 4)
    texts = [(1, None), (2, ""), (3, "word " * 60_000), (4, "x" * 300_000), (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "no id"), (None, None)]
    for name, data in (("none", []), ("odd", [(i, t, *extra) for i, t in texts])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            function(spark, docs, folder).write.parquet(f"{folder}/{stage}")
            after = spark.read.parquet(f"{folder}/{stage}")
            if stage != "packing":
                assert after.columns == docs.columns
            docs = after
        if name == "none":
            assert docs.count() == 0 and corpus_pipeline.run(spark, folder).count() == 0
        else:
            kept = spark.read.parquet(f"{folder}/near_dedup").collect()
            assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, 3, 4, 5, None, None], key=str)  # 2 equals 1: both empty
            assert {r["doc_id"] for r in docs.collect()} == {1, 3, 4, 5, None}


def test_registered():
    import __spark_entry__

    found = set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= found
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
