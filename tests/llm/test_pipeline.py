"""The corpus pipeline, stage by stage against brute force, and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_operators import EDGES, SCHEMA, contamination, links  # noqa: E402

from rallyframe.llm.common import release, settle  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, after = docs, settle(stage(spark, docs, sf))
        texts = {r.doc_id: r.text for r in before.collect()}
        kept = {r.doc_id for r in after.collect()}
        if name != "mix_sources":
            assert after.columns == columns and kept <= texts.keys()
        if name == "language_id":
            assert kept == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
        if name == "near_dedup":
            assert kept == {i for i, x in links(texts.items(), 80).items() if x[2]}
        if name == "decontaminate":
            assert kept == {i for i, x in contamination(texts.items(), items).items() if not x[4]}
        docs = after
    assert docs.agg(F.sum("taken")).first()[0] > 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


@pytest.mark.parametrize("rows", [EDGES, []])
def test_odd_tables(spark, sf, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf))
    assert docs.count() <= len(rows)


def test_own_columns_go_through(spark, sf):
    """Columns named as results or inner columns of the operators stay as they are."""
    names = ["score", "lang_pred", "evidence", "_n_removed", "_N_lines", "start", "_row", "_k1", "_k2", "size", "key", "taken", "bucket", "n", "row", "c", "_exact", "_n_words", "held", "draw", "a b"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf))
        assert docs.columns == columns
    assert docs.select(*[F.col(f"`{n}`") for n in names]).distinct().collect() == [tuple(f"own {n}" for n in names)]
    assert corpus_pipeline.mix_sources(spark, docs, sf).count() == docs.count() > 0


def test_language_id_rejects_unlearnt_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(5)
    junk = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(200))
    greek = "η γρήγορη αλεπού πηδά πάνω από το σκυλί " * 20
    odd = [(-1, greek, None, "o", len(greek)), (-2, junk, None, "o", len(junk)), (-3, "Ж", None, "o", 1)]
    both = " ".join(r.text for r in docs.where("lang IN ('en', 'fr') AND n_chars > 500").orderBy("n_chars").limit(2).collect())
    odd.append((-4, both, None, "o", len(both)))
    given = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, given, sf).collect()}
    clean = {r.doc_id for r in docs.where("text RLIKE '[a-zA-Z]'").collect()}
    assert kept == clean | {-4}


def test_release(spark):
    held = settle(spark.range(3))
    files = held.inputFiles()
    assert held.count() == 3 and files
    release(spark)
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.schema(held.schema).parquet(*files).count()
