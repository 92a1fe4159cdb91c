"""Finding where a text may share a long window with another place, without comparing texts.

A text is a sequence of units, words or bytes.  Of the phrases of ``phrase`` units inside a window of ``window``
units, the one with the least hash is the window's anchor; equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share theirs.  So a window that occurs twice has an anchor that occurs twice, and only a
small part of all phrases is ever an anchor.  Windows in a row with one anchor make a span; spans whose anchor
recurs are the candidates, and every recurring window lies inside one of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import NO_ID, keep_table, parts, per_process, text_id, text_of

BASE = 0x9E3779B97F4A7C15
#: Distinct spans of one anchor that a task holds together; where there are more, their windows are dealt out by more phrases than the anchor.
CROWD = 2000


@dataclass(frozen=True)
class Windows:
    """What is compared: ``window`` units of a text, by anchors of ``phrase`` units."""

    window: int
    phrase: int
    words: bool

    def units(self, text: str) -> tuple[list[bytes] | bytes, np.ndarray]:
        import xxhash

        data = text.encode()
        if not self.words:
            return data, np.frombuffer(data, np.uint8).astype(np.uint64)
        words = data.split()
        return words, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def joined(self, units: list[bytes] | bytes) -> bytes:
        return b" ".join(units) if self.words else bytes(units)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64th."""
    kept = per_process(("powers",), dict)
    if len(kept.get("up", ())) < n:
        size = max(n, 1 << 17)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept["up"], kept["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return kept["up"][:n], kept["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` units in a row."""
    if len(units) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(units) - n + 1])


def spans(units: np.ndarray, kind: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor's hash, the first window and the number of windows of every span, in order."""
    phrases = rolling(units, kind.phrase)
    width = kind.window - kind.phrase + 1
    n = len(phrases) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The least hash, and of equal ones the last: its upper half above the place counted from the end.
    low = np.uint64(0xFFFFFFFF)
    least = (phrases & ~low) | (low - np.arange(len(phrases), dtype=np.uint64))
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n], least[width - reach : width - reach + n])
    at = (low - (least & low)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return phrases[at[first]].view(np.int64), first, np.diff(np.r_[first, n])


def signatures(docs: DataFrame, kind: Windows) -> DataFrame:
    """doc_id, id (null as the largest), tid (names the text), n units, sha256 of the units, and the spans' anchors and places."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            n, sha, anchors, firsts, counts = [], [], [], [], []
            for text in part[2]:
                units, hashes = kind.units(text.as_py())
                a, f, c = spans(hashes, kind)
                n.append(len(units))
                sha.append(hashlib.sha256(kind.joined(units)).hexdigest())
                anchors.append(a)
                firsts.append(f)
                counts.append(c)
            ends = pa.array(np.r_[0, np.cumsum([len(a) for a in anchors])], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), t)) for x, t in ((anchors, pa.int64()), (firsts, pa.int32()), (counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(n, pa.int64()), pa.array(sha), *lists], names=["doc_id", "tid", "n", "sha", "anchor", "first", "count"])

    rows = docs.select("doc_id", text_id(docs).alias("tid"), text_of(docs).alias("text"))
    found = rows.mapInArrow(read, "doc_id long, tid binary, n long, sha string, anchor array<long>, first array<int>, count array<int>")
    return found.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))


def texts_once(sig: DataFrame) -> DataFrame:
    """A row for each different text: tid, owner (its smallest id), copies, n, and its spans."""
    one = sig.groupBy("tid").agg(F.min("id").alias("owner"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first(F.struct("anchor", "first", "count")).alias("s"))
    return one.filter(F.size("s.anchor") > 0)


def candidate_spans(texts: DataFrame, name: str) -> DataFrame:
    """tid and the places of its spans whose anchor occurs in two texts, or twice in one.

    The anchors that do are a table of their own, so that the join with them can be split where one anchor has much of all rows.
    """
    zipped = F.explode(F.arrays_zip("s.anchor", "s.first", "s.count")).alias("z")
    rows = texts.select("tid", zipped).select("tid", "z.anchor", "z.first", "z.count")
    twice = keep_table(rows.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("anchor").alias("twice")), f"{name}-anchors")
    found = rows.join(twice, F.col("anchor") == F.col("twice"))
    return found.groupBy("tid").agg(F.collect_list(F.struct("first", "count", "anchor")).alias("places"))


def candidate_texts(docs: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """tid, owner, copies, text and places of each text that has candidates, once."""
    about = places.join(texts.select("tid", "owner", "copies"), "tid")
    rows = docs.select(text_id(docs).alias("of"), text_of(docs).alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    # Of equal texts the one of the owner; rows that repeat it are dropped.
    joined = rows.join(about, (F.col("of") == F.col("tid")) & (F.col("id") == F.col("owner")))
    return joined.select("tid", "owner", "copies", "text", "places").dropDuplicates(["tid"])


def cut_out(found: DataFrame, kind: Windows) -> DataFrame:
    """The candidates' spans: a row for each place, and the content once for each different span of a task.

    key names the content; rows with a content have null in tid.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()
        for b in batches:
            for k in range(0, b.num_rows, 64):
                rows = []
                for tid, owner, copies, text, places in zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True):
                    units = text.encode().split() if kind.words else text.encode()
                    for p in places:
                        content = kind.joined(units[p["first"] : p["first"] + p["count"] + kind.window - 1])
                        key = xxhash.xxh3_128_digest(content)
                        rows.append((p["anchor"], key, tid, owner, copies, p["first"], None))
                        if key not in seen:
                            seen.add(key)
                            rows.append((p["anchor"], key, None, None, None, None, content))
                if rows:
                    kinds = pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
                    names = ["anchor", "key", "tid", "owner", "copies", "first", "content"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return found.select("tid", "owner", "copies", "text", "places").mapInArrow(read, "anchor long, key binary, tid binary, owner long, copies long, first int, content binary")


def distinct_spans(cut: DataFrame) -> DataFrame:
    """anchor, key, content of each different span, how often it occurs and the smallest and largest of its texts' owners."""
    count = cut.filter("tid IS NOT NULL").groupBy("key").agg(F.sum("copies").alias("times"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    content = cut.filter("tid IS NULL").select("key", "anchor", "content").dropDuplicates(["key"])
    return content.join(count, "key").select("anchor", "key", "content", "times", "low", "high")


def by_anchor(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct spans whose anchor has few enough to be looked at together, and those of the other anchors."""
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("spans")).filter(F.col("spans") > CROWD).select(F.col("anchor").alias("crowded"))
    few = distinct.join(crowded, F.col("anchor") == F.col("crowded"), "left_anti")
    return few, distinct.join(crowded, F.col("anchor") == F.col("crowded"), "left_semi")


def finer(hashes: np.ndarray, kind: Windows, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``spans`` with the ``most`` least phrases of a window for its anchor; with as many as a window has, the window itself."""
    phrases = rolling(hashes, kind.phrase)
    width = kind.window - kind.phrase + 1
    if most >= width:
        keys = rolling(hashes, kind.window)
        return keys.view(np.int64), np.arange(len(keys)), np.ones(len(keys), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(phrases, width)
    least = np.sort(np.partition(view, most - 1, axis=1)[:, :most], axis=1)
    keys = np.zeros(len(least), np.uint64)
    for k in range(most):
        keys = mixed(keys * np.uint64(BASE) + least[:, k])
    # Where the least phrase, of equal ones the last, changes its place, a window may come again.
    at = np.arange(len(view)) + width - 1 - view[:, ::-1].argmin(axis=1)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])])
    return keys[first].view(np.int64), first, np.diff(np.r_[first, len(keys)])


def finer_spans(crowd: DataFrame, kind: Windows, most: int) -> DataFrame:
    """Spans cut into shorter ones: parent (the key of what was cut), at (its place there), and the columns of ``distinct_spans``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()
        names = ["parent", "at", "anchor", "key", "content", "times", "low", "high"]
        for b in batches:
            for k in range(0, b.num_rows, 64):
                rows = []
                for parent, content, times, low, high in zip(*(c.to_pylist() for c in b.slice(k, 64).columns), strict=True):
                    units = content.split(b" ") if kind.words else content
                    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units)) if kind.words else np.frombuffer(content, np.uint8).astype(np.uint64)
                    for anchor, at, n in zip(*(x.tolist() for x in finer(hashes, kind, most)), strict=True):
                        part = kind.joined(units[at : at + n + kind.window - 1])
                        rows.append((parent, at, anchor, xxhash.xxh3_128_digest(part), part, times, low, high))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return crowd.select("key", "content", "times", "low", "high").mapInArrow(read, "parent binary, at int, anchor long, key binary, content binary, times long, low long, high long")


def found_by(look: Callable[[DataFrame], DataFrame], distinct: DataFrame, kind: Windows, name: str) -> DataFrame:
    """What ``look`` finds in spans that share an anchor, for all ``distinct`` spans: key and parts, one or more rows for a key.

    Spans of an anchor that has too many are cut where the least two phrases of their windows change, then four, and so on, up to whole windows, of
    which an anchor has but one; what is found in a piece holds at its place in the span.
    """
    hits, cuts, most = None, [], 1
    while True:
        few, crowd = by_anchor(distinct)
        found = look(few)
        for places in reversed(cuts):
            moved = F.transform("parts", lambda p: p.withField("a", p["a"] + F.col("at")).withField("b", p["b"] + F.col("at")))
            found = found.withColumnRenamed("key", "of").join(places, F.col("of") == F.col("key")).select(F.col("parent").alias("key"), moved.alias("parts"))
        hits = found if hits is None else hits.unionByName(found)
        if crowd.isEmpty():
            return hits
        most *= 2
        fine = keep_table(finer_spans(crowd, kind, most), f"{name}-finer")
        cuts.append(fine.select("parent", "at", "key"))
        same = fine.groupBy("key").agg(F.first("anchor").alias("anchor"), F.first("content").alias("content"), F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))
        distinct = keep_table(same.select("anchor", "key", "content", "times", "low", "high"), f"{name}-distinct")


def chunks(batches: Iterator[pa.RecordBatch], units: int) -> Iterator[list[tuple]]:
    """Rows sorted by their first column, in lists that hold all rows of an anchor and about ``units`` bytes of content."""
    held, size, anchor = [], 0, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size >= units and row[0] != anchor:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[2])
            anchor = row[0]
    if held:
        yield held


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching stretches joined, in order."""
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def candidates(docs: DataFrame, kind: Windows, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures, different texts, texts with candidates, and their spans, each a table in the shared folder."""
    sig = keep_table(signatures(docs, kind), f"{name}-signatures")
    texts = keep_table(texts_once(sig), f"{name}-texts")
    found = keep_table(candidate_texts(docs, candidate_spans(texts, name), texts), f"{name}-candidates")
    return sig, texts, found, keep_table(cut_out(found, kind), f"{name}-spans")
