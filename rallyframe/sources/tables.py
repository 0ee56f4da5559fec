"""Declared tables, reads with quarantine, and sinks."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULTS = T.StructType([
    T.StructField("match_uid", T.StringType()), T.StructField("tournament_id", T.StringType()), T.StructField("circuit", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("round", T.StringType()), T.StructField("draw", T.StringType()),
    T.StructField("p1_id", T.StringType()), T.StructField("p2_id", T.StringType()), T.StructField("winner_id", T.StringType()), T.StructField("result_type", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("tournament_start_date", T.DateType()), T.StructField("match_date", T.DateType()),
])
TICKS = T.StructType([
    T.StructField("tick_id", T.LongType()), T.StructField("match_uid", T.StringType()), T.StructField("book", T.StringType()), T.StructField("market", T.StringType()), T.StructField("points", T.DoubleType()), T.StructField("side", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("active", T.BooleanType()), T.StructField("ts", T.TimestampType()),
])
SNAPSHOTS = T.StructType([
    T.StructField("match_uid", T.StringType()), T.StructField("book", T.StringType()), T.StructField("player_id", T.StringType()), T.StructField("odds", T.DoubleType()), T.StructField("status", T.StringType()), T.StructField("start_time", T.TimestampType()), T.StructField("fetched_at", T.TimestampType()),
])


def schema_hash(schema: T.StructType) -> str:
    """Names and types of a schema, in order, as a fingerprint for drift checks."""
    return hashlib.md5(json.dumps([(f.name, f.dataType.simpleString(), f.nullable) for f in schema]).encode()).hexdigest()


_scratch: dict[str, str] = {}


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder that the cluster names in
    ``spark.checkpoint.dir`` and read back, so that plans above it stay small and
    a lost executor costs no more than them. Without that setting a local master
    gets a temporary folder; a cluster must name one."""
    spark = df.sparkSession
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _scratch.setdefault(app, tempfile.mkdtemp(prefix="rallyframe-core-"))
    path = f"{root.rstrip('/')}/{app}/{uuid.uuid4().hex}"
    # Positions for names: a column may be called anything.
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)])).parquet(path).toDF(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """All files below ``root``, with a declared schema: nothing is inferred."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(root)


def json_records(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", str(multiline).lower()).json(path)


def delimited(spark: SparkSession, path: str, fields: list[str], by: str = "|") -> DataFrame:
    """Lines of key=value records split by ``by``, the named fields as columns."""
    parts = F.split("value", rf"\{by}")
    value = lambda f: F.get(F.transform(F.filter(parts, lambda x: F.startswith(x, F.lit(f"{f}="))), lambda x: F.substring_index(x, "=", -1)), F.lit(0))
    return spark.read.text(path).select(*[value(f).alias(f) for f in fields])


def validated(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with the names of those failed."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("reject_reason", failed)
    return marked.where(F.size("reject_reason") == 0).drop("reject_reason"), marked.where(F.size("reject_reason") > 0)


def result_checks() -> dict[str, Column]:
    """What a result row must satisfy."""
    return {
        "players": F.col("p1_id") != F.col("p2_id"),
        "winner": F.col("winner_id").isNull() | F.col("winner_id").isin(F.col("p1_id"), F.col("p2_id")),
        "walkover": (F.col("result_type") != "walkover") | F.coalesce(F.col("reason") == "W/O", F.lit(False)),
    }


def match_uid(circuit: Column, tournament: Column, year: Column, draw: Column, round_: Column, a: Column, b: Column) -> Column:
    """Key of a match, the same from either side; null with a player unknown."""
    pair = F.array_sort(F.array(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("_", circuit, tournament, year.cast("string"), draw, round_, pair[0], pair[1]))


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that ``df`` has. Rows of a partition meet in few
    tasks by a rebalance, which splits a hot partition over several files."""
    df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def recover_table(spark: SparkSession, path: str) -> None:
    """Finish a swap of ``replace_table`` that was cut off between its two renames:
    the table put aside last comes back, and what is left of others goes."""
    at, fs = _files(spark, path.rstrip("/"))
    beside = sorted((s for s in fs.listStatus(at.getParent()) or [] if s.getPath().getName().startswith(f"{at.getName()}.")), key=lambda s: s.getModificationTime()) if fs.exists(at.getParent()) else []
    old = [s.getPath() for s in beside if s.getPath().getName().endswith(".old")]
    if old and not fs.exists(at) and not fs.rename(old.pop(), at):
        raise OSError(f"cannot restore {path}")
    for p in [*old, *[s.getPath() for s in beside if s.getPath().getName().endswith(".new")]]:
        fs.delete(p, True)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and swap, so that ``df`` may read from it. A swap
    that fails puts the old table back; one that is cut off is finished by
    ``recover_table``. One writer at a time."""
    spark, path = df.sparkSession, path.rstrip("/")
    fresh = f"{path}.{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{fresh}.new")
    at, fs = _files(spark, path)
    new, old = _files(spark, f"{fresh}.new")[0], _files(spark, f"{fresh}.old")[0]
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        raise OSError(f"cannot put {path} aside")
    if not fs.rename(new, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"cannot move the new table to {path}")
    fs.delete(old, True)


META = "_schema_hash"


def write_checked(df: DataFrame, path: str) -> None:
    """``replace_table`` with the schema's hash in a file beside the data."""
    replace_table(df, path)
    at, fs = _files(df.sparkSession, f"{path.rstrip('/')}/{META}")
    out = fs.create(at, True)
    out.write(schema_hash(df.schema).encode())
    out.close()


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of ``write_checked``; an error if it was written with another schema."""
    recover_table(spark, path)
    at, fs = _files(spark, f"{path.rstrip('/')}/{META}")
    if not fs.exists(at):
        raise ValueError(f"{path} has no schema hash")
    stream = fs.open(at)
    found = bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    stream.close()
    if found != schema_hash(schema):
        raise ValueError(f"{path} was written with another schema")
    return spark.read.schema(schema).parquet(path)


def delimited_table(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """A CSV table with a declared schema; fields that don't fit are null."""
    return spark.read.schema(schema).option("header", str(header).lower()).option("enforceSchema", "false" if header else "true").csv(path)


def write_delimited(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def overridden(df: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``df`` with fields replaced by those of a table of overrides or aliases by
    key, where they are not null there. Several rows of a key are an error."""
    one = overrides.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.max(f).alias(f"_o_{f}") for f in fields])
    sure = one.select(F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("a key has several overrides"))).alias(key), *[f"_o_{f}" for f in fields])
    out = df.join(sure, key, "left").withColumns({f: F.coalesce(f"_o_{f}", f) for f in fields})
    return out.select(*df.columns)
