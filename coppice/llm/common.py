"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coppice.sources.stored import drop, written  # noqa: F401 (the operators take them from here)

#: The bytes that make up a word (digits, lower-case letters and all of
#: UTF-8 beyond ASCII); A-Z become a-z and every other byte a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

#: Bytes in an Arrow batch, beyond which it ends (one longer text is a batch of its own).
BATCH_BYTES = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes. The plan reads the setting when it runs, so it stays lowered for the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Memory that this worker has freed goes back to the system, so waiting workers stay small."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: At most this many keys can each hold more than one in HOT_KEYS of all rows.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], n: str, total: int, how: str = "left") -> DataFrame:
    """rows LEFT (or LEFT-then-filtered) JOIN keyed, which has one row a key and a row count ``n`` for it.

    Keys with more than total/HOT_KEYS rows (so at most HOT_KEYS of them) are broadcast and
    their rows leave the shuffled join. A key below that can still be more than a task should take;
    such a partition is split by adaptive execution (the keyed side has one row for it, so any split
    is right). Key columns must not be null.
    """
    least = max(total // HOT_KEYS, 1000)
    values = [c for c in keyed.columns if c not in keys]
    hot = F.broadcast(keyed.where(F.col(n) > least).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*values).alias("__hot")))
    cold = keyed.where(F.col(n) <= least).select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.struct(*values).alias("__cold"))
    cond = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    out = rows.join(hot, _all(cond), "left").drop(*[f"__h_{k}" for k in keys])
    # rows of hot keys are dealt by their own hash, which matches nothing, so no task gets all of a key
    out = out.withColumn("__deal", F.when(F.col("__hot").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*keys)))
    cold = cold.withColumn("__cdeal", F.xxhash64(*[f"__c_{k}" for k in keys]))
    cond = [F.col("__deal") == F.col("__cdeal"), *[F.col(k) == F.col(f"__c_{k}") for k in keys]]
    out = out.join(cold, _all(cond), "left")
    if how == "inner":
        out = out.where(F.col("__hot").isNotNull() | F.col("__cold").isNotNull())
    got = F.coalesce("__hot", "__cold")
    return out.select(*rows.columns, *[got[v].alias(v) for v in values])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(__id, __label, __turn) of at most max_rows labelled ids outside the held-out quarter, in order of a hash (__turn).

    Small enough to broadcast. An id with both labels counts as 1; null ids and labels are left out.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    return rows.withColumn("__turn", F.xxhash64(F.col("__id").cast("string"))).orderBy("__turn", F.col("__id")).limit(max_rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __label, __turn, __text) of the labelled sample's documents; a null text is empty."""
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.join(F.broadcast(labelled_sample(labels, label, max_rows, id_col)), "__id").select("__id", "__label", "__turn", "__text")


def fit_in_one_task(rows: DataFrame, order: list[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Trains in a single task, on rows that a sample bounds; so neither they nor the fit are in the driver."""
    return map_batches(rows.repartition(1).sortWithinPartitions(*order), fn, schema)
