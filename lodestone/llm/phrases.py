"""Removing passages that a document with a smaller id already has, by automata of repeated phrases.

Documents are cut into spans that may recur (see ``recurring``), and a shard gets all spans of an anchor.  It confirms
which passages recur and who has each first, compiles them into an Aho-Corasick automaton over words, and streams the
shard's spans through it to find every place where one occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recurring import Windows, candidates, chunks, distinct_spans, found_by, merged
from .shared import keep_table

#: Bytes of spans whose passages one automaton holds.
SHARD = 1 << 20
HITS = "key binary, parts array<struct<a:int,b:int,m:long>>"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def located(rows: list[tuple], window: int) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """For each span of a shard the stretches of words that also start in the text of an owner ``m``, as (a, b, m).

    ``rows`` are (anchor, key, content, times, low, high), low and high being the smallest and largest owner of the span.
    """
    from ahocorasick import Automaton

    letters: dict[bytes, str] = {}
    texts = []
    for row in rows:
        for w in (words := row[2].split(b" ")):
            if w not in letters:
                k = 256 + len(letters)
                letters[w] = chr(k if k < 0xD800 else k + 0x800)
        texts.append("".join([letters[w] for w in words]))
    first: dict[str, list[int]] = {}
    for text, (*_, low, high) in zip(texts, rows, strict=True):
        for k in range(len(text) - window + 1):
            if (has := first.setdefault(text[k : k + window], [low, high])) is not None:
                has[0], has[1] = min(has[0], low), max(has[1], high)
    # Passages: windows in a row that recur and that one owner has first.
    passages: dict[str, int] = {}
    for text in texts:
        owners = [has[0] if (has := first[text[k : k + window]])[0] < has[1] else None for k in range(len(text) - window + 1)]
        for owner, run in groupby(range(len(owners)), owners.__getitem__):
            if owner is not None:
                run = list(run)
                passages[text[run[0] : run[-1] + window]] = owner
    if not passages:
        return []
    phrases = Automaton()
    for passage, owner in passages.items():
        phrases.add_word(passage, (len(passage), owner))
    phrases.make_automaton()
    found = []
    for text, (_, key, _, _, _, high) in zip(texts, rows, strict=True):
        by_owner: dict[int, list[tuple[int, int]]] = {}
        for end, (n, owner) in phrases.iter(text):
            if owner < high:
                by_owner.setdefault(owner, []).append((end + 1 - n, end + 1))
        if by_owner:
            found.append((key, [(a, b, m) for m, parts in by_owner.items() for a, b in merged(parts)]))
    return found


def located_in_shards(few: DataFrame, window: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, SHARD):
            if found := located(rows, window):
                parts = pa.array([[{"a": a, "b": b, "m": m} for a, b, m in p] for _, p in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), parts], names=["key", "parts"])

    return few.select("anchor", "key", "content", "times", "low", "high").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(read, HITS)


def without_passages(docs: DataFrame, window: int = 50, phrase: int = 16) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept_sha256.

    Each word goes that is covered by ``window`` words in a row whose sequence also starts in a document with a smaller id;
    windows are judged on the input.  Null texts have no word, and shorter texts lose none.  A null id
    is the largest; rows that share an id are one document's, which does not count against itself.  An empty table gives none; other columns are ignored.
    Of equal texts only one is looked through; the others hold no window that it does not hold.
    """
    kind = Windows(window, phrase, True)
    sig, texts, found, cut = candidates(docs, kind, "phrases")
    hits = found_by(lambda few: located_in_shards(few, window), keep_table(distinct_spans(cut), "phrases-distinct"), kind, "phrases")
    places = cut.filter("tid IS NOT NULL").select("key", "tid", "owner", "first").alias("c").join(hits.alias("h"), F.col("c.key") == F.col("h.key"))
    mine = F.transform(F.filter("h.parts", lambda p: p["m"] < F.col("c.owner")), lambda p: F.struct((p["a"] + F.col("c.first")).alias("a"), (p["b"] + F.col("c.first")).alias("b")))
    removed = places.select("c.tid", mine.alias("parts")).filter(F.size("parts") > 0).groupBy("tid").agg(F.flatten(F.collect_list("parts")).alias("parts"))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                tids, counts, shas = [], [], []
                for tid, text, parts in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    words = text.encode().split()
                    gone, kept, at = 0, [], 0
                    for a, e in merged([(p["a"], p["b"]) for p in parts]):
                        kept += words[at:a]
                        gone, at = gone + e - a, e
                    tids.append(tid)
                    counts.append(gone)
                    shas.append(hashlib.sha256(b" ".join(kept + words[at:])).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(counts, pa.int64()), pa.array(shas)], names=["of", "gone", "kept"])

    struck = found.select("tid", "text").join(removed, "tid").select("tid", "text", "parts").mapInArrow(strike, "of binary, gone long, kept string")
    about = texts.select(F.col("tid").alias("of"), "owner").join(struck, "of", "left")
    joined = sig.select("doc_id", "id", "tid", "n", "sha").join(about, F.col("tid") == F.col("of"), "left")
    copy = F.coalesce(F.col("id") > F.col("owner"), F.lit(False))
    return joined.select(
        "doc_id", F.col("n").alias("n_words"), F.when(copy, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
