"""What the operators of this subpackage share: written intermediates and text constants."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes: A-Z to a-z and the white space of SPACE to a blank.
LOWER_SPACED = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a folder of our own on a local
    master; on a cluster that would be a different disk for each executor, so it is an error."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='ligature-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/ligature-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """uid and row (all columns of ``docs``), written. Numbers depend on how the input is split, and the
    split on the executors of the moment, so every later step reads the numbers written here."""
    return written(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "numbered")


def texts_of(base: DataFrame) -> DataFrame:
    """uid, doc_id and text (null: empty) of a ``numbered`` table."""
    return base.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), whole_text("row.text"))


def without(base: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a ``numbered`` table but those whose uid ``dropped`` lists, with their own columns.

    The list is written first: the planner knows its size and broadcasts it only if it is small."""
    return base.join(written(dropped.select("uid").distinct(), "dropped"), "uid", "left_anti").select("row.*")


def forget(spark: SparkSession) -> None:
    """Delete every intermediate that this application has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias("text")


def splitmix(n: int, seed: int = 0) -> list[int]:
    """``n`` 64-bit values of the splitmix64 sequence: a table from a rule."""
    out, x, m = [], seed, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & m
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
        out.append(z ^ (z >> 31))
    return out


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task's results stay small beside its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
