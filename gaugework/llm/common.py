"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Words are runs of anything but space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def token_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is unset, a new local one in local mode (as in tests);
    a cluster without one raises, as executors cannot see a folder of the driver's machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = path.get() if path.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gaugework-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path if "://" in path or path.startswith("file:") else "file://" + path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/gaugework/{name}-{uuid.uuid4().hex[:12]}"


#: Spark drops a query's shuffle files when the query ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(spark: SparkSession, df: DataFrame, name: str, finished: Iterable[DataFrame] = (), compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage is cut and a lost executor loses nothing.

    Its shuffle files go when it is written, and so do the tables of this function that ``finished`` lists, which nothing may read any more.
    """
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    for old in finished:
        delete_table(spark, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def bucketed(spark: SparkSession, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` as ``written``, its rows in buckets by ``column``: read back, what is grouped or joined by that column does not shuffle this side again.

    A bucket is read by one task. The catalogue knows the table only until it is read back; the files stay.
    """
    path, table = new_folder(spark, name), f"spark_catalog.default.gaugework_{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format("parquet").bucketBy(buckets, column).option("path", path).option("compression", "snappy").saveAsTable(table)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of a table with a path of its own only the name goes
    out._written_path = path
    return out


def delete_table(spark: SparkSession, table: DataFrame) -> None:
    """Drop a table that ``written`` or ``bucketed`` made."""
    delete_folder(spark, table._written_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, shards: int, column: str) -> DataFrame:
    """Each number of ``column`` (int, 0 to ``shards`` - 1) in a partition of its own."""
    return df.repartitionById(shards, F.col(column))


def with_fields(fields: list[StructField], more: str = "") -> StructType:
    """Fields of a table as they are, and further ones in DDL."""
    return StructType([StructField(f.name, f.dataType) for f in fields] + (StructType.fromDDL(more).fields if more else []))


def split_batches(batches: Iterator[pa.RecordBatch], column: str, rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows`` rows and about ``size`` bytes of ``column``, so that memory is bounded by one slice and one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.maximum(np.cumsum(lengths) // size, np.arange(len(lengths)) // rows)
        cuts = np.flatnonzero(np.diff(step)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """A batch with all its columns as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def read_rows(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)) as reader:
        return reader.read_next_batch()


def runs(sorted_numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each number of a sorted array, and where it stands."""
    cuts = np.flatnonzero(np.append(True, sorted_numbers[1:] != sorted_numbers[:-1])) if len(sorted_numbers) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sorted_numbers)]):
        yield int(sorted_numbers[a]), slice(a, b)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def fold_of(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
