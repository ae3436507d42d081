"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters that this package strips or splits at: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: bytes.translate table: A-Z lower-cased, every other ASCII character but 0-9 and a-z a blank.
WORD_BYTES = bytes(
    ord(" ") if b < 0x80 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters that ``lower`` leaves alone or, below 0x80, changes as wished: no upper-case letter outside ASCII is among them.
_PLAIN = r"\x00-\x7F\u00A0-\u00BF\u00D7\u00DF-\u00FF\u03AC-\u03CE\u0430-\u045F\u0600-\u109F\u2010-\u206F\u3000-\u9FFF\uAC00-\uD7A3"


def lower_ascii(col: Column) -> Column:
    """A-Z only.  ``lower`` is several times as fast as ``translate`` and serves where it changes no other letter."""
    plain = (F.octet_length(col) == F.length(col)) | ~col.rlike(f"[^{_PLAIN}]")
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores added as keep it apart from df's columns, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks(spark: SparkSession) -> int:
    """The number of partitions that shuffles of this session have."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a written side that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, of so many counted rows of a few dozen bytes each, with a broadcast hint only up to the bound."""
    return F.broadcast(df) if rows <= most else df


_local = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see.  Only a session within one JVM, as in tests, gets a temporary folder if none is set."""
    global _local
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local = _local or tempfile.mkdtemp(prefix="quarry-")
    return path.rstrip("/")


class Scratch:
    """Folders written within a :func:`scratch` block, and those among them that its result still reads."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """A written table that outlives the block, or goes with the block around it."""
        self.kept.add(df._written)
        return df


_scope: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes what :func:`written` makes inside, but for tables that are kept."""
    own, around = Scratch(), _scope.get()
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)
        for path in own.paths:
            if path not in own.kept:
                _delete(spark, path)
            elif around is not None:
                around.paths.append(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends here, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop_written(df: DataFrame) -> None:
    """Removes a table made by :func:`written` that no later step reads."""
    _delete(df.sparkSession, df._written)


def gapless_rank(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds a rank from 0, without gaps, among the rows of each key.

    A key may hold a third of all rows, so no task gets a whole key: rows are dealt to hash buckets
    of their first order column, ranked inside (key, bucket), and shifted by the number of rows in the
    key's earlier buckets.  There are four buckets a shuffle partition, so they grow with the job; the table of counts has
    that many rows a key.
    """
    buckets = max(256, 4 * tasks(df.sparkSession))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        df.groupBy(key, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(inner))
        .join(base, [key, "_bucket"])
        .withColumn(name, F.col("_base") + F.col("_r") - 1)
        .drop("_bucket", "_base", "_r")
    )


def text_hash(col: Column) -> Column:
    return F.xxhash64(F.coalesce(col, F.lit("")))


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """make()'s result as a Python worker keeps it: tasks that one worker runs share it and its caches.  Only the last one asked for is held."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go what an earlier stage's tasks left in this worker, and gives the memory back to the system where that can be asked for."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def shared(kind: type, uid: str, state: tuple):
    """A model as a Python worker reads it."""

    def make():
        got = kind(*state)
        got.uid = uid
        return got

    return held(uid, make)


#: Rows of a batch that are Python objects at a time.
SLICE = 1024


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows, so that a task's Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


#: Spark's defaults for Arrow batches, and what takes their place: whole texts and index blocks are large rows.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(SLICE)),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def light_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to SLICE rows and 8 MB where they are at their defaults.

    The executor and its Python worker hold batches besides all else; of rows of megabytes, 64 MB a batch is too much for both."""
    for key, (default, value) in _BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def map_texts(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable], alone: bool = False) -> DataFrame:
    """Runs make() once a task; the function it returns takes the columns' lists of a batch and returns rows' lists.

    alone: it uses nothing that workers hold.  Text columns come as bytes, null as b"".  Output columns follow schema's order.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    light_batches(df.sparkSession)
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if alone:
            release()
        f = make()
        for batch in slices(batches):
            lists = []
            for i, field in enumerate(batch.schema):
                col = batch.column(i)
                if pa.types.is_string(field.type) or pa.types.is_large_string(field.type):
                    lists.append([x or b"" for x in col.cast(pa.large_binary()).to_pylist()])
                else:
                    lists.append(col.to_pylist())
            got = f(*lists)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t.type) for v, t in zip(got, out)], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def sampled(docs: DataFrame, labels: DataFrame, column: str, fit_docs: int, fit_chars: int) -> list[tuple[str, object]]:
    """(text, label) of at most fit_docs documents of at most fit_chars characters: those whose id hashes least, one row an id.

    Of an id's repeated rows the least text and the greatest label count.  Ids are chosen first, so texts don't meet in a sort."""
    able = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).alias("_label"))
    chosen = able.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    texts = docs.where(F.length("text") <= fit_chars).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").alias("label")).collect()
    return sorted((r.text, r.label) for r in rows)
