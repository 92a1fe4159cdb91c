"""Folders, tables and column helpers that the corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
#: Stands for a null id, as the largest.
NO_ID = 2**63 - 1


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder of the cluster, with its scheme.

    The cluster names that folder in ``spark.checkpoint.dir``.  Only in a local session that leaves it unset, as in tests, a
    temporary folder takes its place; on a cluster executors would not see that one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: what follows has no lineage to lose.

    Shuffle files of the jobs behind it are of no more use; a collection of the driver's garbage lets Spark drop them.
    """
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``keep_table`` wrote and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "kept_at", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def text_id(docs: DataFrame) -> Column:
    return F.unhex(F.md5(text_of(docs).cast("binary")))


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``chosen(doc_id, tid)``, with all their columns; of rows that repeat both, one.

    Which of such rows stays is settled by a hash of their other columns.
    """
    named = docs.withColumns({"one_row_id": F.coalesce("doc_id", F.lit(NO_ID)), "one_row_text": text_id(docs)})
    wanted = chosen.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("wanted_id"), F.col("tid").alias("wanted_text"))
    met = named.join(wanted, (F.col("one_row_id") == F.col("wanted_id")) & (F.col("one_row_text") == F.col("wanted_text")), "left_semi")
    turn = Window.partitionBy("one_row_id", "one_row_text").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    return met.withColumn("one_row_turn", F.row_number().over(turn)).filter("one_row_turn = 1").select(*docs.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def parts(batches, column: int, rows: int = 256, size: int = 1 << 20):
    """Slices of record batches of at most ``rows`` rows and, unless a single row has more, ``size`` bytes in ``column``: what a task turns into objects at once."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < b.num_rows:
            upto = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + size, "right"))
            n = max(1, min(rows, upto - k))
            yield b.slice(k, n)
            k += n


def open_store(uri: str):
    """File system and path of a shared folder, for tasks that write or read whole files."""
    from pyarrow import fs

    uri = re.sub("^s3[an]:", "s3:", uri)
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if uri.startswith("file://") else uri.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), uri


def put_file(uri: str, write) -> None:
    """Let ``write`` fill a file, which appears under its name only once complete; repeated tasks replace it."""
    system, path = open_store(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        write(out)
    system.move(part, path)


def per_process(key: tuple, make):
    """What ``make`` returned for ``key`` in this Python process, for models that are costly to load for every task."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("lodestone_worker_memory", ModuleType("lodestone_worker_memory")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
