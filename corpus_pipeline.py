"""A training-data pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a table that is written and
read back before the next one. All but the last return the columns of
``documents``. Nulls, empty texts, repeated rows and extra columns are treated
as each operator's docstring says; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm import decontam, langid, linededup, mixing, neardup
from rallyframe.llm.common import SPACE_CHARS, documents, keyed, settle, unpacked


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; null and letterless texts go, and texts
    that reach less than half (``BAR``) of every language's usual share. Repeated
    rows fare alike; other columns go through."""
    held = langid.training_fold(F.col("doc_id")) == 1
    filters = langid.fit_levels(docs, langid.fit_languages(docs, ~held), held)
    found = langid.identify(keyed(docs, "text"), filters, carry=("_row",))
    told = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("evidence") >= langid.BAR)
    return found.where(told).select(*unpacked(docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines of repeated windows; one of which nothing is left
    goes. Null, empty and untouched texts stay as they are, repeated rows fare
    alike and other columns go through; n_chars follows the text."""
    cut = linededup.dedup_lines(keyed(docs, "doc_id", "text"))
    left = F.translate("text", SPACE_CHARS, "") != ""
    n_chars = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row")["n_chars"])
    return cut.where((F.col("_n_removed") == 0) | left).select(*unpacked(docs.columns, text=F.col("text"), n_chars=n_chars))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8.
    Null and empty texts stay, rows that repeat an id and text become one, and
    other columns go through."""
    kept = neardup.drop_near_duplicates(keyed(docs, "doc_id", "text"), percent=80)
    return kept.select(*unpacked(docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates. Null and empty texts stay,
    repeated rows fare alike and other columns go through."""
    out = decontam.decontaminate(keyed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = decontam.covered_words(F.col("_exact"))
    return out.where(~decontam.contaminated(hit, F.col("_n_words"))).select(*unpacked(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left. Null and empty
    texts are taken 0 times; each of repeated rows may be taken."""
    return mixing.mix_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

#: SQL can't express the language filters or the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once they are saved, ``common.release`` deletes the
    tables between the stages."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
