"""Shared pieces of the training-data operators: words, scratch tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: ASCII white space; every other code point belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_root: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates, which the cluster names in
    ``spark.checkpoint.dir``. Where that is unset, a local master gets a
    temporary folder, and a cluster its warehouse if that isn't on the machines'
    own disks; otherwise this is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master == "local" or master.startswith("local["):
        if app not in _own_root:
            _own_root[app] = tempfile.mkdtemp(prefix="rallyframe-")
        return _own_root[app]
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_scratch"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart
    from the written files, not from a lost executor's shuffle output."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a settled table."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


#: A settled table is broadcast up to so many rows and bytes of its files.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def side(df: DataFrame) -> DataFrame:
    """A settled table, marked for broadcast only if it is small."""
    small = written_bytes(df) <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(df) if small else df


def release(spark: SparkSession) -> None:
    """Delete this application's written intermediates, once results are saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Maximal runs outside ASCII white space; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable cannot be
    inlined into ``body`` by the optimizer, where it would run once per element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, step, emit) -> Column:
    """``emit(state, value)`` for each value in order, with ``state`` the fold of
    ``step`` over the values before it.

    An array grown by one element at a time costs the square of its length, so
    the values are folded in chunks of about the cube root of twice their number:
    100,000 values copy 40 elements each, and a million 90.
    """
    def chunk(state: Column, part: Column) -> Column:
        grow = lambda acc, v: F.struct(step(acc["state"], v).alias("state"), F.concat(acc["out"], F.array(emit(acc["state"], v))).alias("out"))
        return F.aggregate(part, F.struct(state.alias("state"), F.slice(F.array(emit(state, F.get(part, F.lit(0)))), 1, 0).alias("out")), grow)

    def chunks(v: Column) -> Column:
        size = F.ceil(F.cbrt(F.size(v) * 2)).cast("int")
        return let(size, lambda c: F.transform(F.sequence(F.lit(1), F.size(v), c), lambda i: F.slice(v, i, c)))

    def joined(acc: Column, part: Column) -> Column:
        return let(chunk(acc["state"], part), lambda done: F.struct(done["state"].alias("state"), F.concat(acc["out"], F.array(done["out"])).alias("out")))

    def whole(v: Column) -> Column:
        none = F.slice(F.array(F.slice(F.array(emit(zero, F.get(v, F.lit(0)))), 1, 0)), 1, 0)
        return F.aggregate(chunks(v), F.struct(zero.alias("state"), none.alias("out")), joined, lambda acc: F.flatten(acc["out"]))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.slice(F.array(emit(zero, F.get(v, F.lit(0)))), 1, 0)))


def bucket_of_id(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that name a row by content: repeated rows share a key and so a
    result, and equal ids with different texts stay apart."""
    return (F.xxhash64(doc_id, text, doc_id.isNull(), text.isNull()), F.hash(text, doc_id, text.isNull()))


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column, so that its names can't meet an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``docs`` and all its columns as one struct ``_row``."""
    return packed(docs).select(*[F.col("_row")[c].alias(c) for c in names], "_row")


def unpacked(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of a packed table, some replaced."""
    return [changed.get(c, F.col("_row")[c]).alias(c) for c in columns]


def without(carry, *made: str) -> tuple[str, ...]:
    """The carried names less those that an operator makes itself, which replace them."""
    taken = {m.lower() for m in made}
    return tuple(c for c in carry if c.lower() not in taken)


def made_schema(given: DataFrame, carry, **made: str) -> StructType:
    """The schema of a batch function that passes columns of ``given`` on and
    adds others; types as objects, as names in text may not parse."""
    kept = [StructField(c, given.schema[c].dataType) for c in carry]
    return StructType(kept + [StructField(c, StructType.fromDDL(f"x {kind}")[0].dataType) for c, kind in made.items()])


def shipped(module):
    """``module``, sent to executors by value: they need no copy of this library."""
    cloudpickle.register_pickle_by_value(module)
    return module
