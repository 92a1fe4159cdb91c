"""Near-duplicate documents by SetSketch registers.

Each element of a set draws one value for every register, in rising order from exponentially spaced intervals, and a
register keeps the least value drawn for it, on a logarithmic scale.  Registers of a union are the lesser of both, and two
sets agree in a register with a chance close to their similarity.  Documents that agree in a band of registers are candidates;
the registers that are greater, less and equal give the likelihood of the similarity jointly with the sizes; what
may reach the threshold is confirmed on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .recurring import mixed, rolling
from .shared import NO_ID, forget, keep_table, one_row_each, parts, text_id, text_of

#: Registers, a prime number, so that steps of any length visit each once; bands of registers.
REGISTERS = 131
BANDS, ROWS = 32, 4
#: The scale of registers: base, rate and greatest value.
SCALE, RATE, TOP = 1.001, 20.0, 65534
#: A pair is dropped unconfirmed if its registers are this much likelier, in logarithms, under another similarity than under the threshold.
UNLIKELY = 12.0
#: Shingles of the members of a bucket that one task holds while the bucket's others pass by, and members that pass by in one task.
HELD, PASSING = 1 << 20, 4096


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles; of fewer words, the hash of them all."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    return np.unique(rolling(hashes, size))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set, a row each; of an empty one all are 0."""
    m = REGISTERS
    # Ends of the intervals; a value of the last one has no upper end.
    ends = np.r_[np.log1p(np.arange(m) / (m - np.arange(m))) / RATE, np.inf]
    least = np.full((len(sets), m), np.inf)
    flat = least.ravel()
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    start = (mixed(h ^ np.uint64(0xA5A5A5A5)) % np.uint64(m)).astype(np.int64)
    step = (mixed(h ^ np.uint64(0x5A5A5A5A5A)) % np.uint64(m - 1)).astype(np.int64) + 1
    for j in range(m):
        u = (mixed(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        x = ends[j] - np.log1p(u * np.expm1(-RATE * (ends[j + 1] - ends[j]))) / RATE
        np.minimum.at(flat, owner * m + (start + step * j) % m, x)
        # Further values are beyond the next end; where no register is, the set is done.
        go = (least.max(axis=1) > ends[j + 1])[owner]
        if not go.all():
            h, owner, start, step = h[go], owner[go], start[go], step[go]
        if not len(h):
            break
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / math.log(SCALE)) + TOP // 2, 0, TOP + 1).astype(np.uint16)


def loglikelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given how many registers of sets of sizes ``a`` and ``b`` are more, less and equal."""
    union = (a + b) / (1 + j)
    parts = [np.maximum(x, 2e-3) for x in ((union - b) / union, (union - a) / union, j)]
    return more * np.log(parts[0]) + less * np.log(parts[1]) + equal * np.log(parts[2])


def may_reach(ra: np.ndarray, rb: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of registers and sizes leave it open that the similarity is ``percent`` or more."""
    more, less = (ra > rb).sum(-1), (ra < rb).sum(-1)
    equal = ra.shape[-1] - more - less
    limit = percent / 100
    most = np.minimum(a, b) / np.maximum(a, b)
    at_limit = loglikelihood(np.full(most.shape, limit), more, less, equal, a, b)
    best = np.full(most.shape, -np.inf)
    for k in range(1, 20):
        j = np.minimum(limit * k / 20, most)
        best = np.maximum(best, loglikelihood(j, more, less, equal, a, b))
    return (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (best - at_limit <= UNLIKELY)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, id (null as the largest), tid, n (size of its set), set_id (names the set, null if empty), registers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in parts(batches, 2):
            sets = [shingles(x.as_py()) for x in part[2]]
            registers = sketch(sets)
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part[0], part[1], pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([r.tobytes() for r in registers], pa.binary())], names=["doc_id", "tid", "n", "set_id", "registers"]
            )

    rows = docs.select("doc_id", text_id(docs).alias("tid"), text_of(docs).alias("text"))
    return rows.mapInArrow(read, "doc_id long, tid binary, n long, set_id binary, registers binary").withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))


def representatives(rows: DataFrame) -> DataFrame:
    """A row for each different set: vertex, owner (its smallest id) and that one's tid, set_id, n, registers."""
    one = rows.filter("n > 0").groupBy("set_id").agg(F.min(F.struct("id", "tid")).alias("o"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    return one.select(F.monotonically_increasing_id().alias("vertex"), F.col("o.id").alias("owner"), F.col("o.tid").alias("tid"), "set_id", "n", "registers")


def banded(reps: DataFrame) -> DataFrame:
    keys = [F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]
    return reps.select("vertex", F.posexplode(F.array(*keys)).alias("band", "key"))


def shared(buckets: DataFrame) -> DataFrame:
    """The members of buckets that have more than one."""
    several = buckets.groupBy("key").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b")).filter("a < b").select(F.col("key").alias("of"))
    return buckets.join(several, F.col("key") == F.col("of")).select("key", "vertex")


def star_pairs(members: DataFrame, worth: Column) -> DataFrame:
    """Each member of a bucket with the one of greatest ``worth``: as many pairs as members, however large a bucket is."""
    hubs = members.groupBy("key").agg(F.max(F.struct(worth.alias("worth"), (-F.col("vertex")).alias("turn"), "vertex", "root")).alias("h")).select(F.col("key").alias("of"), F.col("h.vertex").alias("hub"), F.col("h.root").alias("hub_root"))
    met = members.join(hubs, F.col("key") == F.col("of")).filter("root <> hub_root")
    return met.select(F.least("hub", "vertex").alias("x"), F.greatest("hub", "vertex").alias("y")).distinct()


def still_open(members: DataFrame) -> DataFrame:
    """Members of the buckets in which links have not joined all to one component."""
    still = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select(F.col("key").alias("of"))
    return members.join(still, F.col("key") == F.col("of")).drop("of")


def rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members with the root of their component as it is now."""
    return members.drop("root").join(found, F.col("vertex") == F.col("node"), "left").withColumn("root", F.coalesce("root", "vertex")).drop("node")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose registers do not rule the similarity out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 3, 2048):
            if b.num_rows:
                grid = lambda c: np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(b.num_rows, REGISTERS)  # noqa: B023, E731
                size = lambda c: np.array(b[c].to_pylist(), np.float64)  # noqa: B023, E731
                yield b.select([0, 1]).filter(pa.array(may_reach(grid(3), grid(5), size(2), size(4), percent)))

    a = reps.select(F.col("vertex").alias("x"), F.col("n").alias("nx"), F.col("registers").alias("rx"))
    b = reps.select(F.col("vertex").alias("y"), F.col("n").alias("ny"), F.col("registers").alias("ry"))
    return pairs.join(a, "x").join(b, "y").filter(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select("x", "y", "nx", "rx", "ny", "ry").mapInArrow(read, "x long, y long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets have that similarity, as links (u, v)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 3):
            keep = []
            for s, t in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (b[0], b[1])], names=["u", "v"])

    first = pairs.join(sets.select(F.col("vertex").alias("x"), F.col("elements").alias("sx")), "x")
    return first.join(sets.select(F.col("vertex").alias("y"), F.col("elements").alias("sy")), "y").select("x", "y", "sx", "sy").mapInArrow(read, "u long, v long")


def full_sets(docs: DataFrame, reps: DataFrame, vertices: DataFrame) -> DataFrame:
    """vertex, n and elements, the sorted hashes of its shingles, of each of ``vertices(vertex)``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            sets = [shingles(x.as_py()) for x in part[1]]
            yield pa.RecordBatch.from_arrays([part[0], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["vertex", "n", "elements"])

    wanted = vertices.distinct().join(reps.select("vertex", "owner", "tid"), "vertex")
    rows = docs.select(text_id(docs).alias("of"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), text_of(docs).alias("text"))
    texts = rows.join(wanted, (F.col("id") == F.col("owner")) & (F.col("of") == F.col("tid"))).select("vertex", "text").dropDuplicates(["vertex"])
    return texts.mapInArrow(read, "vertex long, n long, elements binary")


def able(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members, with n and free, that can have a link in an open bucket.

    A shingle that no other set of an open bucket has can be in common with none of them; the others are free.  A set may reach the threshold
    with one that has just what is free of it, at best.  Copies that were changed apart from each other have shingles of their own,
    so this settles most of a large group at a cost in proportion to its text.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            sets = [np.frombuffer(x, np.int64) for x in part[1].to_pylist()]
            vertices = np.repeat(np.array(part[0].to_pylist(), np.int64), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(np.concatenate(sets))], names=["vertex", "shingle"])

    here = sets.join(opened.select("vertex").distinct(), "vertex")
    once = here.select("vertex", "elements").mapInArrow(read, "vertex long, shingle long").groupBy("shingle").agg(F.count("*").alias("times"), F.min("vertex").alias("vertex")).filter("times = 1")
    own = once.groupBy("vertex").agg(F.count("*").alias("own"))
    free = here.select("vertex", "n").join(own, "vertex", "left").select("vertex", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("free")).filter(100 * F.col("free") >= percent * F.col("n"))
    return opened.join(free, "vertex")


def links_across(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join the components of every open bucket as far as they are linked there.

    The members outside a bucket's largest component are held by a task, ``HELD`` shingles of them, and all members pass by, ``PASSING``
    in a task; what they have in common is counted on the full sets.  Only links leave a task, fewer than it holds members,
    as members that links have joined already are not looked at again.
    """
    groups = opened.groupBy("key", "root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    per = groups.groupBy(F.col("key").alias("of")).agg(F.max_by("root", F.struct("members", "root")).alias("main"), F.sum("members").alias("members"), (F.sum("shingles") - F.max(F.struct("members", "root", "shingles"))["shingles"]).alias("shingles"))
    plan = per.select("of", "main", F.ceil(F.col("shingles") / HELD).cast("int").alias("parts"), F.ceil(F.col("members") / PASSING).cast("int").alias("slices"))
    rows = opened.join(plan, F.col("key") == F.col("of"))
    turn = lambda seed, n: F.pmod(F.xxhash64("vertex", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "i", "j", "passes", "vertex", "root", "n", "free"]
    held = rows.filter("root <> main").withColumn("i", turn(1, "parts")).withColumn("j", upto("slices")).withColumn("passes", F.lit(False)).select(*columns)
    passing = rows.withColumn("i", upto("parts")).withColumn("j", turn(2, "slices")).withColumn("passes", F.lit(True)).select(*columns)
    full = held.unionByName(passing).join(sets.select(F.col("vertex").alias("w"), "elements"), F.col("vertex") == F.col("w")).select(*columns, "elements")

    def compare(members: list[tuple], rest: Iterator[tuple]) -> Iterator[tuple[int, int]]:
        sizes, free = (np.array([m[c] for m in members], np.float64) for c in (6, 7))
        own = [np.frombuffer(m[8], np.uint64) for m in members]
        names, place = np.unique(np.concatenate(own), return_inverse=True)
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])[np.argsort(place, kind="stable")]
        ends = np.r_[0, np.cumsum(np.bincount(place))]
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        tops = np.array([m[5] for m in members])
        for w in rest:
            most = np.minimum(free, w[7])
            if not ((tops != top(w[5])) & (100 * most >= percent * (sizes + w[6] - most))).any():
                continue
            elements = np.frombuffer(w[8], np.uint64)
            at = np.searchsorted(names, elements)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == elements)]
            n = ends[at + 1] - ends[at]
            if not len(at):
                continue
            steps = np.arange(n.sum()) + np.repeat(ends[at] - np.r_[0, np.cumsum(n)[:-1]], n)
            common = np.bincount(owner[steps], minlength=len(own))
            for k in np.flatnonzero(100 * common >= percent * (sizes + w[6] - common)):
                a, b = top(members[k][5]), top(w[5])
                if a != b:
                    joined[a] = b
                    tops = np.array([top(m[5]) for m in members])
                    yield members[k][4], w[4]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in parts(batches, 8) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, group in groupby(rows, lambda r: r[:3]):
            members, first = [], None
            for row in group:
                if row[3]:
                    first = row
                    break
                members.append(row)
            if members and first:
                links = list(compare(members, chain([first], group)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["u", "v"])

    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "passes").mapInArrow(read, "u long, v long").distinct()


def near_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept, tid (names the text), root (names its component; null without words).

    A set has the different runs of five words, in lower case for A to Z; fewer words are one run, and a null text or one without words
    has none and no links.  Sets with 100 * common >= ``percent`` * all are linked, and component_id is the smallest id that links lead to.
    Equal sets are one vertex, so groups of copies of any size cost one.  A null id is the largest; rows that share an id are each judged by
    their text, and if they repeat it both have the same answer.  An empty table gives none; other columns are ignored; texts of any length are
    read whole.  With 32 bands of 4 registers a pair just at 0.75 is missed with a chance of 5 in a million, and a component only if all its links
    there are.
    """
    rows = keep_table(sketches(docs), "near-sketches")
    reps = keep_table(representatives(rows), "near-sets")
    members = keep_table(shared(banded(reps)).withColumn("root", F.col("vertex")), "near-buckets")
    sets = keep_table(full_sets(docs, reps, members.select("vertex")), "near-elements")

    def joined(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
        found = components(links if before is None else before.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links), "near-components")
        forget(links, *([] if before is None else [before]))
        return found

    # First each bucket around any one member, then around the one of which most is shared, then whatever is still apart.
    found = joined(keep_table(confirmed(likely(star_pairs(members, F.lit(0)), reps, percent), sets, percent), "near-links"))
    opened = keep_table(still_open(rooted(members, found)), "near-open")
    ready = keep_table(still_open(able(opened, sets, percent)), "near-able")
    forget(members, opened)
    if not ready.isEmpty():
        found = joined(keep_table(confirmed(likely(star_pairs(ready, F.col("free") / F.col("n")), reps, percent), sets, percent), "near-links"), found)
        opened = keep_table(still_open(rooted(ready, found)), "near-open")
        links = keep_table(links_across(opened, sets, percent), "near-links")
        forget(opened)
        if not links.isEmpty():
            found = joined(links, found)
    forget(ready, sets)
    owners = reps.select("vertex", "set_id", "owner").join(found, F.col("vertex") == F.col("node"), "left").withColumn("root", F.coalesce("root", "vertex"))
    # Only vertices of links need a group's smallest id; the others have their own.
    linked = found.select("root").union(found.select("node")).distinct().withColumnRenamed("root", "v")
    smallest = owners.join(linked, F.col("vertex") == F.col("v"), "left_semi").groupBy("root").agg(F.min("owner").alias("smallest")).withColumnRenamed("root", "of")
    named = owners.join(smallest, F.col("root") == F.col("of"), "left").select(F.col("set_id").alias("of_set"), F.coalesce("smallest", "owner").alias("component"), "root")
    answered = rows.select("doc_id", "id", "n", "set_id", "tid").join(named, F.col("set_id") == F.col("of_set"), "left").withColumn("component", F.coalesce("component", "id"))
    return answered.select("doc_id", F.col("n").alias("n_shingles"), F.nullif(F.col("component"), F.lit(NO_ID)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"), "tid", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their group, with all their columns.

    Of rows that repeat an id and its text one stays.  If rows with the smallest id have different texts of the group, the one whose text has
    the least digest stays.  Rows with null ids count as the largest.
    """
    kept = near_groups(docs).filter("kept")
    alone = kept.groupBy(F.coalesce(F.col("root").cast("string"), F.concat_ws(":", F.hex("tid"), "doc_id")).alias("group")).agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "tid", "doc_id")).alias("first"))
    return one_row_each(docs, alone.select("first.doc_id", "first.tid"))


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tid", "root")
