"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunked import delete, new_path, tidied  # noqa: F401  (tidied and new_path for the operators)

#: Bytes of text that one Python step of an operator holds at once, and of a batch between the JVM and Python where the session sets none.
CHUNK_BYTES, BATCH_BYTES = 4 << 20, 12 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches are counted in rows by default, and texts can be long: bound their bytes too, unless the session has its own bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table that materialise() wrote and that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


#: Bytes of a table of ids that may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in gone. Ids alone travel where they are few enough, as counted; else both sides are shuffled.

    Rows without a doc_id stay."""
    gone = materialise(gone.filter("doc_id is not null").select("doc_id").distinct(), "gone")
    if gone.count() * 40 <= BROADCAST_BYTES:  # a hashed id takes some 20 bytes, and twice that while its table grows
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> str:
    """The secret of the surrogates that the session names in spark.terrane.surrogateKey. The registered queries fall back on a word that
    is no secret, so that they can be run again; set the key wherever surrogates must not be turned back."""
    return spark.conf.get("spark.terrane.surrogateKey", "not a secret")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, or a single row."""
    for batch in batches:
        i = batch.schema.get_field_index(text)
        sizes = pc.binary_length(batch.column(i)).fill_null(0).to_pylist()
        start, held = 0, 0
        for k, n in enumerate(sizes):
            if k > start and held + n > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)
    release()


def release() -> None:
    """Give freed memory back to the system: idle Python workers stay alive and count for their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
