"""Removing byte strings that occur more than once, by sorting suffixes in two stages.

Documents are cut into spans that may recur (see ``recurring``), and a shard gets all spans of an anchor.  Its
suffix array is made by sorting only the suffixes that are smaller than their successors, and inducing the others by a
scan over the buckets of first bytes; common prefixes of neighbours then tell which strings occur twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recurring import Windows, candidates, chunks, distinct_spans, found_by, merged
from .shared import keep_table

#: Bytes of spans that are sorted together.
SHARD = 2 << 20
#: A byte that UTF-8 never has; it ends each span.
STOP = 0xFF
HITS = "key binary, parts array<struct<a:int,b:int>>"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def eights(text: np.ndarray, ahead: int) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like them; beyond the end there are zeros."""
    padded = np.r_[text, np.zeros(ahead + 8, np.uint8)]
    out = np.zeros(len(text) + ahead, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one is not, as the end is the smallest."""
    n = len(text)
    changes = np.r_[text[1:] != text[:-1], True]
    ahead = np.minimum.accumulate(np.where(changes, np.arange(n), n)[::-1])[::-1]
    after = np.r_[text, 0].astype(np.int32)
    after[n] = -1
    return after[ahead + 1] > after[ahead]


def sort_directly(at: np.ndarray, key8: np.ndarray, depth: int) -> np.ndarray:
    """Places ``at`` in the order of the ``depth`` bytes from them on; only ties of eight bytes are looked at further."""
    if len(at) < 2:
        return at
    order = at[np.argsort(key8[at], kind="stable")]
    key = key8[order]
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    where = np.arange(len(order))
    for done in range(8, depth, 8):
        # What still ties with a neighbour.
        tied = np.zeros(len(group), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        where, group = where[tied], group[tied]
        if not len(where):
            break
        key = key8[order[where] + done]
        differ = (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        if not differ.any():
            continue
        mixed_groups = np.zeros(group[-1] + 1, bool)
        mixed_groups[group[1:][differ]] = True
        pick = np.flatnonzero(mixed_groups[group])
        inner = np.lexsort((key[pick], group[pick]))
        order[where[pick]] = order[where[pick]][inner]
        key[pick] = key[pick][inner]
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All places of ``text``, which ends with ``STOP``, in the order of their suffixes, as far as ``depth`` bytes tell them apart."""
    n = len(text)
    key8 = eights(text, depth + 8)
    up = rising(text)
    direct = sort_directly(np.flatnonzero(up), key8, depth)
    by_byte = np.searchsorted(text[direct], np.arange(257))
    # Of each bucket the suffixes greater than their successors, in the order in which the scan finds them.
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    parts = []

    def pass_on(found: np.ndarray, c: int) -> None:
        before = found[found > 0] - 1
        before = before[~up[before] & (text[before] > c)]
        if len(before):
            byte = text[before]
            turn = np.argsort(byte, kind="stable")
            before, byte = before[turn], byte[turn]
            cuts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(byte)], strict=True):
                induced[byte[a]].append(before[a:b])

    for c in range(256):
        step = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        whole = [step]
        while len(step):  # a byte in front that is the same falls into this very bucket
            before = step[step > 0] - 1
            step = before[~up[before] & (text[before] == c)]
            whole.append(step)
        falling = np.concatenate(whole)
        rise = direct[by_byte[c] : by_byte[c + 1]]
        parts += [falling, rise]
        pass_on(np.concatenate([falling, rise]), c)
    return np.concatenate(parts)


def repeated(spans: list[bytes], window: int) -> list[np.ndarray]:
    """For each of the different ``spans`` the starts of strings of ``window`` bytes that start somewhere else as well."""
    lengths = np.array([len(s) for s in spans])
    text = np.frombuffer(b"".join(s + bytes([STOP]) for s in spans), np.uint8)
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    order = suffix_array(text, window)
    # Only places with a whole window ahead count.
    owner = np.repeat(np.arange(len(spans)), lengths + 1)
    whole = np.arange(len(text)) + window <= (starts + lengths)[owner]
    order = order[whole[order]]
    key8 = eights(text, window + 8)
    pair = np.arange(len(order) - 1)
    for k in range(0, window, 8):
        a, b = key8[order[pair] + k], key8[order[pair + 1] + k]
        if window - k < 8:
            a, b = (x >> np.uint64(8 * (8 - (window - k))) for x in (a, b))
        pair = pair[a == b]
    hit = np.zeros(len(text), bool)
    hit[order[pair]] = hit[order[pair + 1]] = True
    places = np.flatnonzero(hit)
    ends = np.searchsorted(places, starts + lengths)
    return [places[a:b] - s for a, b, s in zip(np.searchsorted(places, starts), ends, starts, strict=True)]


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.r_[0, breaks + 1]].tolist(), (starts[np.r_[breaks, len(starts) - 1]] + window).tolist(), strict=True))


def found_in_shard(rows: list[tuple], window: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """For each span, (anchor, key, content, times), the stretches that occur more than once."""
    out, several = [], []
    for _, group in groupby(rows, lambda r: r[0]):
        group = list(group)
        # A span by itself has no window in common with another; one that occurs twice is common as a whole.
        if len(group) == 1 and group[0][3] > 1:
            out.append((group[0][1], [(0, len(group[0][2]))]))
        several += group if len(group) > 1 else []
    if several:
        for (_, key, content, times, *_), starts in zip(several, repeated([r[2] for r in several], window), strict=True):
            parts = [(0, len(content))] if times > 1 else covered(starts, window)
            if parts:
                out.append((key, parts))
    return out


def found_in_shards(few: DataFrame, window: int) -> DataFrame:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, SHARD):
            if found := found_in_shard(rows, window):
                parts = pa.array([[{"a": a, "b": b} for a, b in p] for _, p in found], kind)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), parts], names=["key", "parts"])

    return few.select("anchor", "key", "content", "times").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(read, HITS)


def without_repeats(docs: DataFrame, window: int = 400, phrase: int = 96) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte of the UTF-8 text goes that is covered by ``window`` bytes which also start anywhere else, in any row or in
    the same one; strings are judged on the input.  Null texts are empty, and shorter texts lose nothing.  Rows
    that repeat are places of their own, whatever their id, null too.  An empty table gives none; other columns are ignored.
    Of equal texts only one is looked through; all its windows occur in the others.
    """
    kind = Windows(window, phrase, False)
    sig, texts, found, cut = candidates(docs, kind, "suffixes")
    hits = found_by(lambda few: found_in_shards(few, window), keep_table(distinct_spans(cut), "suffixes-distinct"), kind, "suffixes")
    places = cut.filter("tid IS NOT NULL AND copies = 1").select("key", "tid", "first").alias("c").join(hits.alias("h"), F.col("c.key") == F.col("h.key"))
    mine = F.transform("h.parts", lambda p: F.struct((p["a"] + F.col("c.first")).alias("a"), (p["b"] + F.col("c.first")).alias("b")))
    removed = places.select("c.tid", mine.alias("parts")).groupBy("tid").agg(F.flatten(F.collect_list("parts")).alias("parts"))

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                rows = []
                for tid, text, parts in zip(*(c.to_pylist() for c in b.slice(k, 128).columns), strict=True):
                    data, at, kept = text.encode(), 0, []
                    runs = merged([(p["a"], p["b"]) for p in parts])
                    for a, e in runs:
                        kept.append(data[at:a])
                        at = e
                    kept.append(data[at:])
                    rows.append((tid, sum(e - a for a, e in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
                tids, gone, n, sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.binary()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], names=["of", "gone", "runs", "kept"])

    struck = found.filter("copies = 1").select("tid", "text").join(removed, "tid").select("tid", "text", "parts").mapInArrow(strike, "of binary, gone long, runs long, kept string")
    about = texts.select(F.col("tid").alias("of"), "copies").join(struck, "of", "left")
    joined = sig.select("doc_id", "tid", "n", "sha").join(about, F.col("tid") == F.col("of"), "left")
    copy = F.coalesce(F.col("copies") > 1, F.lit(False))
    pick = lambda whole, part, none: F.when(copy, whole).otherwise(F.coalesce(part, none))
    return joined.select(
        "doc_id", F.col("n").alias("n_bytes"), pick(F.col("n"), F.col("gone"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("runs"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(EMPTY_SHA), F.col("kept"), F.col("sha")).alias("kept_sha256"),
    )


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
