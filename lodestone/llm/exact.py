"""Exact deduplication by a stateful stream.

Documents pass as events of digest, stable identifier and content locator.  The stream's state, on disk
in RocksDB and in the shared checkpoint folder, has an entry for each digest that never expires: how many documents had it, and
the identifier and locator of the one that stays so far.  Where a digest comes back, the full bytes of the document
are compared with those at the locator; should they differ, that digest's documents are grouped by their bytes instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import GAP_CHARS, keep_table, one_row_each, run_dir, text_of

#: State in RocksDB; without space set aside in advance, of which every store would take some megabytes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of a group that are compared in one place.
SHARE = 256
EVENTS = "doc_id long, row_key string, digest string, n_points long"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def events(docs: DataFrame, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """doc_id, row_key (names the row's exact text), digest of the text without white space, code points of the text as it is."""
    gaps = GAP_CHARS.encode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw = [x.as_py().encode() for x in part[1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part[0],
                        "row_key": [hashlib.md5(x).hexdigest() for x in raw],
                        "digest": [digest(x.translate(None, gaps)) for x in raw],
                        "n_points": pa.array([len(x.decode()) for x in raw], pa.int64()),
                    }
                )

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(read, EVENTS)


def best() -> Column:
    """Of a group, the row with the most code points, then the smallest id; a null id counts as the largest."""
    return F.max(F.struct("n_points", (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("minus_id"), "doc_id", "row_key"))


def streamed_state(seen: DataFrame, files_a_batch: int = 64) -> DataFrame:
    """Run the events through the stream to their end: digest, n, keep_id and keep_key, the locator of the row that stays.

    ``seen`` is a table in the shared folder.  Each micro-batch writes the entries it changed under its own
    number, so one that is run again replaces its files; the last write of a digest is its state.  If the job is
    started anew with the same folder, it goes on from the last batch.
    """
    spark = seen.sparkSession
    folder = run_dir(spark, "exact-stream")
    source = seen.inputFiles()[0].rsplit("/", 1)[0]
    # The stream has a session of its own, so that its stores are set up for no other stream.
    session = spark.newSession()
    for k, v in {**{k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.") and spark.conf.isModifiable(k)}, **STORE}.items():
        session.conf.set(k, v)
    stream = session.readStream.schema(seen.schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    entries = stream.groupBy("digest").agg(F.count("*").alias("n"), best().alias("best"))

    def save(changed: DataFrame, batch: int) -> None:
        changed.select("digest", "n", "best").write.mode("overwrite").parquet(f"{folder}/entries/batch={batch}")

    query = entries.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    entries = spark.read.parquet(f"{folder}/entries")
    if len(entries.select("batch").distinct().take(2)) > 1:
        # Counts of a digest only grow.
        entries = keep_table(entries.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("x")).select("digest", "x.n", "x.best"), "exact-state")
    return entries.select("digest", "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_key"))


def compared(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """digest, squeezed, kept_text: the bytes of ``hits(doc_id, row_key, digest, n, keep_id, keep_key)`` and those at their locators.

    A group of many rows is dealt out to shares of about ``SHARE`` rows, each of which meets the group's one text, so no task has all rows of a group.
    """
    texts = docs.select(F.col("doc_id").alias("id"), text_of(docs).alias("text"))
    at = lambda id_, key: F.col(id_).eqNullSafe(F.col("id")) & (F.col(key) == F.md5(F.col("text").cast("binary")))
    squeezed, shares = F.translate("text", GAP_CHARS, ""), F.ceil(F.col("n") / SHARE)
    # The locators are few; the texts behind them are fetched once for all rows that hit them.
    located = hits.select(F.col("digest").alias("kept_digest"), shares.alias("shares"), "keep_id", "keep_key").distinct()
    kept = located.join(texts, at("keep_id", "keep_key")).select("kept_digest", "shares", squeezed.alias("kept_text")).dropDuplicates(["kept_digest"])
    # A table of its own, which the join reads once for each share.
    kept = keep_table(kept, "exact-kept").select("kept_digest", "kept_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("kept_share"))
    dealt = hits.select("doc_id", "row_key", "digest", F.pmod(F.xxhash64("doc_id", "row_key"), shares).alias("share")).distinct()
    mine = dealt.join(texts, at("doc_id", "row_key")).select("digest", "share", squeezed.alias("squeezed"))
    return mine.join(kept, (F.col("digest") == F.col("kept_digest")) & (F.col("share") == F.col("kept_share"))).select("digest", "squeezed", "kept_text")


def bytes_differ(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of ``hits`` whose rows do not all have the bytes at the locator."""
    return compared(docs, hits).filter(F.col("squeezed") != F.col("kept_text")).select("digest").distinct()


def exact_groups(docs: DataFrame, digest: Callable[[bytes], str] = sha256) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, row_key, keep_id, group_size, kept, digest.

    Texts are equal when identical without white space.  Null counts as empty, and empty texts are equal to each
    other.  Of equal texts the row with the most code points stays, then the smallest ``doc_id``; a null id is the largest.  A row that
    occurs twice with one ``doc_id`` counts twice in group_size, and both have the same answer.  An empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    seen = keep_table(events(docs, digest), "exact-events")
    if not seen.inputFiles() or seen.isEmpty():
        return spark.createDataFrame([], "doc_id long, row_key string, keep_id long, group_size long, kept boolean, digest string")
    state = streamed_state(seen)
    found = keep_table(seen.join(state, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_key") == F.col("keep_key"))), "exact-found")
    differ = keep_table(bytes_differ(docs, found.filter("n > 1 AND NOT kept")), "exact-differ")
    columns = ["doc_id", "row_key", "keep_id", F.col("n").alias("group_size"), "kept", "digest"]
    if differ.isEmpty():
        return found.select(*columns)
    # Texts that share a digest without being equal: their bytes are the key.
    texts = docs.select(F.col("doc_id").alias("id"), F.md5(text_of(docs).cast("binary")).alias("key"), F.translate(text_of(docs), GAP_CHARS, "").alias("squeezed")).distinct()
    rest = found.join(differ, "digest", "left_semi").join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key"))).select("doc_id", "row_key", "digest", "n_points", "squeezed")
    groups = rest.groupBy("squeezed").agg(F.count("*").alias("n"), best().alias("best")).select(F.col("squeezed").alias("group"), "n", F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_key"))
    again = rest.join(groups, F.col("squeezed") == F.col("group")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row_key") == F.col("keep_key")))
    return found.join(differ, "digest", "left_anti").select(*columns).unionByName(again.select(*columns))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns; of rows that repeat an id and its text one stays."""
    return one_row_each(docs, exact_groups(docs).filter("kept").select("doc_id", F.unhex("row_key").alias("tid")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS squeezed FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY squeezed) AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha256(squeezed) AS text_sha256
FROM t WINDOW g AS (PARTITION BY squeezed ORDER BY length(text) DESC, doc_id)
"""
