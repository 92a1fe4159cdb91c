"""The most frequent runs of words or characters of a corpus, exactly, and what texts have of them.

A run is at most as frequent as the runs inside it.  So runs are counted length by length, and of each length only those whose two parts,
without the last and without the first, reached a count that the terms asked for have at least; no other run leaves its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.text import whole
from .scans import Best, Places, blocks, slices

#: Runs that the driver takes of one length; counts that a task holds before it hands them on.
MOST, HELD = 400_000, 1 << 19
#: Words from which a first bound for longer runs is found.
GUESSED = 300


def prepared(kind: str, text: Column) -> Column:
    """Words of two letters or more between spaces, or the lower text with white space in a row as one space."""
    low = F.lower(whole(text))
    return F.array_join(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1)), " ") if kind == "words" else F.regexp_replace(low, r"\s\s+", " ")


class Runs:
    """Numbers of the frequent runs of each length from ``first`` on: of words or codes, then of pairs of numbers of the length before."""

    def __init__(self, kind: str, first: int):
        self.kind, self.first = kind, first
        self.base, self.of_base, self.pairs, self.sizes = {}, np.zeros(0, np.int64), [], []

    def begin(self, units: list) -> None:
        """The runs of the first length: words, or codes of characters."""
        self.pairs, self.sizes = [], [len(units)]
        if self.kind == "words":
            self.base = {w.encode(): k for k, w in enumerate(units)}
        else:
            self.base = np.array(units, np.int64)
            self.of_base = np.argsort(self.base)
            self.base = self.base[self.of_base]

    def append(self, pairs: np.ndarray) -> None:
        self.pairs.append(pairs)
        self.sizes.append(len(pairs))

    def codes(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all runs of ``first`` characters, the row of each, and whether it is within its row."""
        cs = [np.frombuffer((t or "").encode("utf-32-le"), np.uint32) for t in texts]
        size = np.array([len(c) for c in cs], np.int64)
        c = np.concatenate([*cs, np.zeros(self.first, np.uint32)]).astype(np.int64)
        total = int(size.sum())
        code = np.zeros(total, np.int64)
        for k in range(self.first):
            code = code << 21 | c[k : k + total]
        left = np.repeat(np.cumsum(size), size) - np.arange(total)
        return code, np.repeat(np.arange(len(texts)), size), left >= self.first

    def found(self, texts: list, upto: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The row of each place of the texts, and for each length up to ``upto`` the number of the run that begins there, or -1."""
        if self.kind == "words":
            words = [(t or "").encode().split() for t in texts]
            get = self.base.get
            at = np.fromiter((x for ws in words for x in [*[get(w, -1) for w in ws], -1]), np.int64)
            row = np.repeat(np.arange(len(texts)), [len(ws) + 1 for ws in words])
        else:
            code, row, ok = self.codes(texts)
            at = number(self.base, code, self.of_base)
            at[~ok] = -1
        levels = [at]
        for k in range(upto - self.first):
            code = self.joined(levels[-1], k)
            levels.append(number(self.pairs[k], code))
        return row, levels

    def joined(self, at: np.ndarray, k: int) -> np.ndarray:
        """Codes of the runs of one more, where both parts are frequent, else -1."""
        after = np.append(at[1:], -1)
        return np.where((at >= 0) & (after >= 0), at * self.sizes[k] + after, -1)


def number(order: np.ndarray, codes: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """The place of each code in ``order``, or what ``of`` has at that place; -1 for others."""
    if not len(order):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(order, codes), len(order) - 1)
    return np.where(order[at] == codes, at if of is None else of[at], -1)


class Counts:
    """Codes with how often and in how many documents they are."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, row: np.ndarray, code: np.ndarray) -> None:
        if len(code):
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
            self.parts.append((code[starts], np.diff(np.append(starts, len(code))), np.ones(len(starts), np.int64)))
            self.size += len(starts)
            if self.size > 2 * HELD:
                self.merge()

    def merge(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        code, n, df = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        different, at = np.unique(code, return_inverse=True)
        self.parts = [(different, np.bincount(at, n).astype(np.int64), np.bincount(at, df).astype(np.int64))]
        self.size = len(different)
        return self.parts[0]


def counted(texts: DataFrame, runs: Runs, length: int) -> DataFrame:
    """unit or code, n, df of the runs of ``length`` that may be frequent, over ``texts(text)``."""
    words = runs.kind == "words" and length == runs.first
    schema = StructType([StructField("code", StringType() if words else LongType()), StructField("n", LongType()), StructField("df", LongType())])
    sent = texts.sparkSession.sparkContext.broadcast(runs)

    def batch(code, n, df):
        return pa.RecordBatch.from_arrays([code, pa.array(n, pa.int64()), pa.array(df, pa.int64())], names=schema.names)

    def of_words(batches):
        n: dict[bytes, int] = {}
        df: dict[bytes, int] = {}

        def out():
            keys = list(n)
            for a in range(0, len(keys), 1 << 16):
                some = keys[a : a + (1 << 16)]
                yield batch(pa.array([w.decode() for w in some], pa.string()), [n[w] for w in some], [df[w] for w in some])

        for b in batches:
            for text in b.column(0):
                ws = (text.as_py() or "").encode().split()
                for w in ws:
                    n[w] = n.get(w, 0) + 1
                for w in set(ws):
                    df[w] = df.get(w, 0) + 1
                if len(n) > HELD:
                    yield from out()
                    n.clear()
                    df.clear()
        yield from out()

    def of_codes(batches):
        runs, counts = sent.value, Counts()
        for _, ts in slices(pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["a", "b"]) for b in batches):
            if length == runs.first:
                code, row, ok = runs.codes(ts)
            else:
                row, levels = runs.found(ts, length - 1)
                code = runs.joined(levels[-1], length - 1 - runs.first)
                ok = code >= 0
            counts.add(row[ok], code[ok])
            if counts.size > HELD and len(counts.parts) == 1:
                yield batch(*map(pa.array, counts.parts[0]))
                counts = Counts()
        yield batch(*map(pa.array, counts.merge()))

    return texts.mapInArrow(of_words if words else of_codes, schema).groupBy("code").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


class Terms:
    """The terms of a choice with their weights: for each length the place of a run among them, or -1."""

    def __init__(self, low: int, high: int, places: list[np.ndarray], weights: np.ndarray):
        self.low, self.high, self.places, self.weights = low, high, places, weights

    def vectors(self, runs: Runs, row: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, term, weight of the texts, in order of rows and terms."""
        rows, terms = [], []
        for n in range(self.low, self.high + 1):
            at = levels[n - runs.first]
            ok = np.flatnonzero(at >= 0)
            term = self.places[n - self.low][at[ok]] if len(ok) else ok
            rows.append(row[ok][term >= 0])
            terms.append(term[term >= 0])
        pairs, tf = np.unique(np.concatenate(rows) * max(1, len(self.weights)) + np.concatenate(terms), return_counts=True)
        row, term = pairs // max(1, len(self.weights)), pairs % max(1, len(self.weights))
        return row, term, tf * self.weights[term]


def chosen(docs: DataFrame, kind: str, choices: list[tuple[int, int, int]]) -> tuple[Runs, list[Terms]] | None:
    """For each choice (low, high, most) the ``most`` frequent runs of ``low`` to ``high``, of equal ones the first by letters, weighted ln((1 + n) / (1 + df)) + 1.

    None if the runs of one length that may be among them are more than the driver takes.
    """
    first = 1 if kind == "words" else min(low for low, _, _ in choices)
    texts, runs = docs.select(prepared(kind, F.col("text")).alias("text")), Runs(kind, first)
    base = counted(texts, runs, first).persist()
    total = docs.count()

    def least(counts: list[np.ndarray], most: int) -> int:
        every = np.concatenate(counts)
        return int(np.partition(every, len(every) - most)[len(every) - most]) if len(every) >= most else 1

    def grown(frame: DataFrame, n: int, names: list | None):
        """The runs of ``n`` of a frame become numbers; their names are made from those of the parts."""
        rows = frame.toArrow()
        codes, counts, df = rows.column(0), rows.column(1).to_numpy(), rows.column(2).to_numpy()
        if n == first:
            units = codes.to_pylist()
            runs.begin(units)
            return (units if kind == "words" else [spelled(c, first) for c in units]), counts, df
        codes = codes.to_numpy()
        order = np.argsort(codes)
        codes, size = codes[order], runs.sizes[n - first - 1]
        runs.append(codes)
        tail = (lambda s: " " + s.rsplit(" ", 1)[-1]) if kind == "words" else (lambda s: s[-1])
        return (None if names is None else [names[c // size] + tail(names[c % size]) for c in codes.tolist()]), counts[order], df[order]

    def at_least(low: int, most: int) -> int:
        """A count that the last of the ``most`` frequent runs of ``low`` and more has or surpasses, from runs of frequent parts alone."""
        frequent = lambda frame, k: frame.orderBy(F.desc("n")).limit(k)
        for n in range(first, low + 1):
            frame = base if n == first else counted(texts, runs, n)
            _, counts, _ = grown(frequent(frame, most if n == low else GUESSED if n == first else 4 * most), n, None)
        return least([counts], most)

    bounds = [at_least(low, most) for low, _, most in choices]
    levels = []
    for n in range(first, max(high for _, high, _ in choices) + 1):
        # Runs of this length are asked for, or parts of longer ones that are.
        floor = min(bound for bound, (_, high, _) in zip(bounds, choices, strict=True) if high >= n)
        frame = (base if n == first else counted(texts, runs, n)).filter(F.col("n") >= floor).limit(MOST + 1).persist()
        many = frame.count()
        if many <= MOST:
            levels.append(grown(frame, n, levels[-1][0] if levels else None))
        frame.unpersist()
        if many > MOST:
            base.unpersist()
            return None
        bounds = [max(bound, least([levels[k - first][1] for k in range(low, n + 1)], most)) if n >= low else bound for bound, (low, _, most) in zip(bounds, choices, strict=True)]
    base.unpersist()
    out = []
    for low, high, most in choices:
        terms = [(-int(c), name.encode(), n, k, int(d)) for n in range(low, high + 1) for k, (name, c, d) in enumerate(zip(*levels[n - first], strict=True))]
        terms = sorted(terms)[:most]
        places = [np.full(runs.sizes[n - first], -1, np.int64) for n in range(low, high + 1)]
        for k, (_, _, n, at, _) in enumerate(terms):
            places[n - low][at] = k
        out.append(Terms(low, high, places, np.log((1 + total) / (1 + np.array([d for *_, d in terms], np.float64))) + 1))
    return runs, out


def spelled(code: int, n: int) -> str:
    return "".join(chr(code >> 21 * k & 0x1FFFFF) for k in range(n - 1, -1, -1))


def with_similarities(pairs: DataFrame, made: list[tuple[Runs, list[Terms]]], names: list[str]) -> DataFrame:
    """The pairs (query, text and others) with a cosine for each choice of terms; 0 where one side has none."""
    out = StructType([*pairs.schema.fields, *[StructField(name, DoubleType()) for name in names]])
    kinds = [runs.kind for runs, _ in made]
    sides = [prepared(kind, F.col(c)).alias(f"{c}_{kind}") for kind in kinds for c in ("query", "text")]
    sent, own = pairs.sparkSession.sparkContext.broadcast(made), len(pairs.columns)

    def task(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                columns = []
                for k, (runs, choices) in enumerate(sent.value):
                    upto = max(t.high for t in choices)
                    both = [runs.found(part.column(own + 2 * k + side).to_pylist(), upto) for side in (0, 1)]
                    columns += [cosine(*[t.vectors(runs, *side) for side in both], part.num_rows, len(t.weights)) for t in choices]
                yield pa.RecordBatch.from_arrays([*part.columns[:own], *map(pa.array, columns)], names=out.names)

    return pairs.select("*", *sides).mapInArrow(task, out)


def cosine(a: tuple, b: tuple, rows: int, size: int) -> np.ndarray:
    norm = lambda v: np.sqrt(np.bincount(v[0], v[2] * v[2], rows))
    key = lambda v: v[0] * max(1, size) + v[1]
    _, x, y = np.intersect1d(key(a), key(b), assume_unique=True, return_indices=True)
    dot, both = np.bincount(a[0][x], a[2][x] * b[2][y], rows), norm(a) * norm(b)
    return np.divide(dot, both, out=np.zeros(rows), where=both > 0)


def weighted_scan(docs: DataFrame, queries: DataFrame, made: tuple[Runs, list[Terms]], k: int) -> DataFrame:
    """query_id, doc_id, score of each task's best ``k`` by cosine of term weights; only such as share a term."""
    runs, (terms,) = made
    spark = docs.sparkSession
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    rows, found = docs.select("doc_id", prepared(runs.kind, F.col("text")).alias("text")), None
    for names, texts in blocks(queries.select("query_id", prepared(runs.kind, F.col("query")).alias("query"))):
        row, term, weight = terms.vectors(runs, *runs.found(texts, terms.high))
        norms = np.sqrt(np.bincount(row, weight * weight, len(texts)))
        lists: list[list] = [[] for _ in texts]
        for r, t, k_th in zip(row.tolist(), term.tolist(), range(len(row)), strict=True):
            lists[r].append((t, k_th))
        places = Places(lists, len(texts))
        here = np.full(len(terms.weights), -1, np.int64)
        for t, at in places.ids.items():
            here[t] = at
        sent = spark.sparkContext.broadcast((runs, terms, places, here, weight, norms))

        def task(batches, sent=sent, names=names):
            runs, terms, places, here, weight, norms = sent.value
            best = Best(names, k, schema.names)
            for ids, ts in slices(batches):
                row, term, own = terms.vectors(runs, *runs.found(ts, terms.high))
                size = np.sqrt(np.bincount(row, own * own, len(ts)))
                ok = here[term] >= 0
                row, own = row[ok], own[ok]
                owner, at = places.met(here[term[ok]])
                key = row[owner] * places.many + places.query[at]
                dot = np.bincount(key, own[owner] * weight[places.number[at]], len(ts) * places.many)
                met = np.flatnonzero(np.bincount(key, minlength=len(dot)))
                if len(met):
                    r, q = met // places.many, met % places.many
                    best.add(ids, r, q, np.round(dot[met] / (norms[q] * size[r]), 6))
            yield from best.out()

        part = rows.mapInArrow(task, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
