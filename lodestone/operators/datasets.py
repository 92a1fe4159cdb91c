"""Training and test pairs.  What is random elsewhere is an order by digest here: the same pairs every time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, whole


def lot(*keys: str, seed: int = 42) -> Column:
    """A place in a shuffled order that depends on the keys and the seed only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_quotes(docs: DataFrame, n: int, low: int = 50, high: int = 500, category: str = "lang", seed: int = 42) -> DataFrame:
    """Texts of ``low`` to ``high`` characters, ``n`` shared out evenly over the categories; a small category gives all it has."""
    fit = docs.filter(F.length("text").between(low, high))
    many = fit.agg(F.countDistinct(category).alias("many"))
    order = Window.partitionBy(category).orderBy(lot("doc_id", seed=seed), "doc_id")
    # No category gives more than ``n``, so the window keeps that many in each task before the shuffle.
    return fit.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).crossJoin(F.broadcast(many)).filter(F.col("place") <= F.floor(F.lit(n) / F.col("many"))).drop("many")


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    return df.orderBy(lot(key, seed=seed), key).limit(n)


def first_half(text: Column) -> Column:
    """The first half of the words if there are over four, else the text."""
    w = tokens(text)
    return F.when(F.size(w) > 4, F.array_join(F.slice(w, F.lit(1), F.floor(F.size(w) / 2).cast("int")), " ")).otherwise(text)


def with_next(docs: DataFrame, parts: int = 64) -> DataFrame:
    """``docs(doc_id, text)`` with next_text, the text of the next document in the order of ids; the last has that of the first, a single one null.

    Ranges of ids are put in order each, and the last of a range takes the first of the next one.
    """
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.001)))
    ranged = docs.withColumn("part", sum((F.coalesce(F.col("doc_id") >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))).withColumn("digest", F.md5("text"))
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("doc_id"), F.col("digest"), F.col("text"))).alias("first"), F.count("*").alias("n"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("part", F.when(F.sum("n").over(every) > 1, F.coalesce(F.lead("first.text").over(Window.orderBy("part")), F.first("first.text").over(every))).alias("after"))
    order = Window.partitionBy("part").orderBy("doc_id", "digest")
    return ranged.withColumn("next_text", F.lead("text").over(order)).join(F.broadcast(ends), "part").withColumn("next_text", F.coalesce("next_text", "after")).drop("part", "digest", "after")


def query_variants(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, variant: the words whole, their first quarter, half and three quarters, last half, middle, windows of up to five, and of eight words or more three drawn spans; and the columns ``more``."""
    words = docs.select("doc_id", *more, tokens(F.col("text")).alias("w")).withColumn("n", F.size("w")).filter("n >= 4")
    cut = lambda start, size: F.array_join(F.slice("w", (F.lit(1) + start).cast("int"), F.greatest(size, F.lit(0)).cast("int")), " ")
    div = lambda k: F.expr(f"n div {k}")
    fixed = [cut(F.lit(0), F.col("n")), cut(F.lit(0), div(4)), cut(F.lit(0), div(2)), cut(F.lit(0), F.expr("3 * n div 4")), cut(div(2), F.col("n") - div(2)), cut(div(4), F.expr("3 * n div 4") - div(4))]
    size = F.least(F.lit(5), div(2)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - size, F.lit(2)), lambda k: F.array_join(F.slice("w", k + 1, size), " "))
    draw = lambda k, name, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string"), F.lit(f"{name}{k}"))), 1, 15), 16, 10).cast("long"), n).cast("int")
    length = lambda k: 3 + draw(k, "size", F.least(F.lit(7), F.col("n") - 1) - 2)
    spans = F.when(F.col("n") >= 8, F.array(*[cut(draw(k, "start", F.col("n") - length(k) + 1), length(k)) for k in range(3)])).otherwise(F.array().cast("array<string>"))
    return words.select("doc_id", *more, F.explode(F.array_distinct(F.concat(F.array(*fixed), windows, spans))).alias("variant")).filter("variant <> ''")


def positive_pairs(docs: DataFrame) -> DataFrame:
    """query, passage, label 1, pair_type and difficulty of every variant of two words or more.

    A variant is words of its passage, so the passage has all of them, and the pair is easy.
    """
    pairs = query_variants(docs, "text").filter(F.size(tokens(F.col("variant"))) >= 2)
    return pairs.select("doc_id", F.col("variant").alias("query"), F.col("text").alias("passage"), F.lit(1).alias("label"), F.lit("positive").alias("pair_type"), F.lit("easy").alias("difficulty"))


def numbered(rows: DataFrame, group: list[str], run: list[str], order: list[str]) -> DataFrame:
    """The rows with place, from 0 on in the order of ``run`` and ``order``, and members, how many their group has.

    ``run`` cuts a group into short runs; places within a run are added to those before it, so no task gets a whole group.
    """
    first = Window.partitionBy(*group).orderBy(*run)
    counts = rows.groupBy(*group, *run).agg(F.count("*").alias("in_run"))
    starts = counts.withColumns({"before": F.sum("in_run").over(first.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_run"), "members": F.sum("in_run").over(Window.partitionBy(*group))}).drop("in_run")
    within = rows.withColumn("at", F.row_number().over(Window.partitionBy(*group, *run).orderBy(*order)))
    return within.join(starts, [*group, *run]).withColumn("place", F.col("before") + F.col("at") - 1).drop("before", "at")


def hard_negatives(docs: DataFrame, anchors: DataFrame, each: int = 2, spread: int = 30, seed: int = 42) -> DataFrame:
    """doc_id, other_id, kind: for each anchor ``each`` other texts of its work, of its category and another work, and of a length within ``spread``
    per cent, and random ones for those of them that there are not.

    Different texts of a group have places in a shuffled order, and what an anchor may take is one stretch of places: all of its work, all of its
    category but the stretch of its work, or the lengths nearby.  It goes round that stretch from a place drawn by lot, as far as it may meet its own text, so no
    anchor meets a whole group, and none that there is is missed.  Rows whose work, category or text is null have no partner by these.
    """
    low, high = 1 - spread / 100, 1 + spread / 100
    draw = F.conv(F.substring("lot", 1, 15), 16, 10).cast("long")
    base = docs.select("doc_id", F.md5(F.col("text")).alias("content"), "source", "lang", F.length("text").alias("n"), lot("doc_id", seed=seed).alias("lot")).filter("content IS NOT NULL")
    first = lambda keys: base.dropna(subset=keys).groupBy(*keys).agg(F.min(F.struct("lot", "doc_id", "n")).alias("m")).select(*keys, "m.lot", "m.doc_id", "m.n").withColumn("run", F.substring("lot", 1, 3))
    wanted = base.join(anchors.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("drawn", draw)
    same = lambda keys: [F.col(f"a.{c}") == F.col(f"b.{c}") for c in keys]
    steps = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))).alias("k")

    def met(rows: DataFrame, reps: DataFrame, keys: list[str], kind: str) -> DataFrame:
        """Of ``rows(doc_id, content, k, want)`` the first with another text."""
        found = rows.alias("a").join(reps.alias("b"), [*same(keys), F.col("a.want") == F.col("b.place")]).filter(F.col("a.content") != F.col("b.content"))
        picked = found.select(F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("other_id"), F.col("a.k").alias("k")).withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")))
        return picked.filter(F.col("r") <= each).select("doc_id", "other_id", F.lit(kind).alias("kind"))

    works = numbered(first(["source", "content"]), ["source"], ["run"], ["lot", "doc_id"])
    here = wanted.alias("a").join(works.alias("b"), same(["source", "content"])).select("a.doc_id", "a.source", "a.content", "b.place", "b.members", steps(F.least(F.lit(each), F.col("b.members") - 1)))
    same_work = met(here.withColumn("want", (F.col("place") + F.col("k") + 1) % F.col("members")), works, ["source"], "same_work")

    categories = numbered(first(["lang", "source", "content"]), ["lang"], ["source", "run"], ["lot", "doc_id"])
    blocks = categories.groupBy("lang", "source").agg(F.min("place").alias("begin"), F.count("*").alias("own"), F.max("members").alias("members"))
    alike = categories.groupBy("lang", "content").agg(F.count("*").alias("alike"))
    here = wanted.join(blocks, ["lang", "source"]).join(alike, ["lang", "content"]).withColumn("others", F.col("members") - F.col("own"))
    here = here.select("doc_id", "lang", "content", "drawn", "begin", "own", "members", "others", steps(F.least(F.col("others"), F.lit(each) + F.col("alike"))))
    same_category = met(here.withColumn("want", (F.col("begin") + F.col("own") + (F.col("drawn") + F.col("k")) % F.col("others")) % F.col("members")), categories, ["lang"], "same_category")

    texts = first(["content"]).withColumn("all", F.lit(0))
    lengths = numbered(texts, ["all"], ["n", "run"], ["lot", "doc_id"])
    # How many texts are shorter than each length that is asked for: one row for each different length.
    marks = wanted.select("n").distinct()
    at = texts.groupBy(F.col("n").cast("double").alias("x")).agg(F.count("*").alias("c")).select("x", F.lit(1).alias("turn"), "c", F.lit(None).cast("int").alias("n"))
    asked_for = marks.select((F.col("n") * F.lit(low)).alias("x"), F.lit(0).alias("turn"), F.lit(0).alias("c"), "n").unionByName(marks.select((F.col("n") * F.lit(high)).alias("x"), F.lit(2).alias("turn"), F.lit(0).alias("c"), "n"))
    upto = at.unionByName(asked_for).withColumn("upto", F.sum("c").over(Window.orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, 0))).filter("n IS NOT NULL")
    near = upto.groupBy("n").agg(F.max(F.when(F.col("turn") == 0, F.col("upto"))).alias("begin"), F.max(F.when(F.col("turn") == 2, F.col("upto"))).alias("end")).withColumn("some", F.col("end") - F.col("begin"))
    here = wanted.join(near, "n").withColumn("all", F.lit(0)).select("doc_id", "all", "content", "drawn", "begin", "some", steps(F.least(F.col("some"), F.lit(each + 1))))
    similar_length = met(here.withColumn("want", F.col("begin") + (F.col("drawn") + F.col("k")) % F.col("some")), lengths, ["all"], "similar_length")

    chosen = same_work.unionByName(same_category).unionByName(similar_length)
    counted = wanted.join(chosen.groupBy("doc_id").agg(F.count("*").alias("got")), "doc_id", "left").withColumn("need", F.lit(3 * each) - F.coalesce("got", F.lit(0))).filter("need > 0")
    every = numbered(texts, ["all"], ["run"], ["lot", "doc_id"])
    here = counted.join(every.select("content", "place", "members"), "content").select("doc_id", "content", "need", "place", "members", steps(F.least(F.col("members") - 1, F.col("need") + 3 * each))).withColumn("want", (F.col("place") + F.col("k") + 1) % F.col("members"))
    others = here.alias("a").join(every.alias("b"), F.col("a.want") == F.col("b.place")).select("a.doc_id", F.col("b.doc_id").alias("other_id"), "a.k", "a.need").join(chosen.select("doc_id", "other_id"), ["doc_id", "other_id"], "left_anti")
    fill = others.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))).filter(F.col("r") <= F.col("need")).select("doc_id", "other_id", F.lit("random").alias("kind"))
    return chosen.unionByName(fill)


def exact_grid(docs: DataFrame, ratios=(0.2, 0.35, 0.5, 0.65), starts=(0.0, 0.25, 0.5), least: int = 15) -> DataFrame:
    """Substrings of texts at every ratio of length and start: doc_id, ratio, start, query."""
    n = F.length("text")
    rows = docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, ratios))).alias("ratio")).select("doc_id", "text", "ratio", F.explode(F.array(*map(F.lit, starts))).alias("start"))
    size, at = F.floor(n * F.col("ratio")).cast("int"), F.floor((n - F.floor(n * F.col("ratio"))) * F.col("start")).cast("int")
    made = rows.select("doc_id", "ratio", "start", F.btrim(F.substring("text", at + 1, size), F.lit(" \t\n\x0b\x0c\r")).alias("query"))
    return made.filter(F.length("query") > least)


def exact_everywhere(docs: DataFrame, ratios=(0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8), least: int = 10) -> DataFrame:
    """Substrings of texts at every ratio, starting at every half of their own length."""
    rows = docs.select("doc_id", "text", F.length("text").alias("n"), F.explode(F.array(*map(F.lit, ratios))).alias("ratio")).withColumn("size", F.floor(F.col("n") * F.col("ratio")).cast("int")).filter(F.col("size") > least)
    starts = F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"), F.greatest(F.lit(1), F.floor(F.col("size") / 2).cast("int")))).alias("start")
    return rows.select("doc_id", "text", "ratio", "size", starts).select("doc_id", "ratio", "start", F.substring("text", F.col("start") + 1, F.col("size")).alias("query"))


def substitutions(docs: DataFrame, table: dict[str, list[str]], words: int = 8) -> DataFrame:
    """The first words of texts with a term replaced by each of its synonyms: doc_id, term, synonym, query."""
    head = docs.select("doc_id", F.array_join(F.slice(tokens(F.lower("text")), 1, words), " ").alias("head"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("term"), F.lit(s).alias("synonym")) for k, ss in table.items() for s in ss])).alias("p")
    rows = head.select("doc_id", "head", pairs).filter(F.contains("head", F.col("p.term")))
    return rows.select("doc_id", "p.term", "p.synonym", F.replace("head", F.col("p.term"), F.col("p.synonym")).alias("query"))


def balanced(positive: DataFrame, negative: DataFrame, n: int, part: float = 0.3, shares: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``n`` pairs, ``part`` of them positive: a share for each difficulty, topped up from the others, and negatives drawn by lot."""
    shares = shares or {"easy": 0.3, "medium": 0.4, "hard": 0.3}
    wanted = int(n * part)
    quota = F.coalesce(F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, int(wanted * v))])[F.col("difficulty")], F.lit(0))
    placed = positive.withColumn("lot", lot("doc_id", "query", seed=seed)).withColumn("place", F.row_number().over(Window.partitionBy("difficulty").orderBy("lot", "doc_id", "query"))).filter(F.col("place") <= wanted)
    # First what the shares ask for, then the rest in order.
    first = placed.withColumn("late", F.col("place") > quota)
    taken = first.orderBy("late", "lot", "doc_id", "query").limit(wanted).drop("lot", "place", "late")
    return taken.unionByName(negative.withColumn("lot", lot("doc_id", "query", "passage", seed=seed)).orderBy("lot", "doc_id", "query").limit(n - wanted).drop("lot"), allowMissingColumns=True)


def assembled(*parts: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """Pairs of several kinds together, in shuffled order, with their lengths; the first ``n`` if asked for."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.withColumns({"query_length": F.length("query"), "passage_length": F.length("passage"), "length_ratio": F.length("query") / F.greatest(F.length("passage"), F.lit(1))})
    out = out.orderBy(lot("query", "passage", seed=seed), "query", "passage")
    return out.limit(n) if n else out


# Letters that a scan mistakes for others.
LOOKALIKE = {"a": "ā", "i": "ī", "u": "ū", "r": "ṛ", "n": "ṇ", "s": "ś", "t": "ṭ", "d": "ḍ"}


def noisy(texts: Column, keys: Column, rate: float = 0.1) -> Column:
    """Texts as a bad scan has them: some words with a letter mistaken or lost, by a lot drawn from the key."""
    import random

    @F.pandas_udf("string")
    def spoil(text: pd.Series, key: pd.Series) -> pd.Series:
        def one(t, k):
            r, out = random.Random(f"{k}"), []
            for w in (t or "").split():
                if len(w) > 3 and r.random() < rate:
                    at = r.randrange(len(w))
                    if r.random() < 0.5:
                        w = w[:at] + LOOKALIKE.get(w[at], w[at]) + w[at + 1 :]
                    elif len(w) > 4 and r.random() < 0.3:
                        at = 1 + r.randrange(len(w) - 2)
                        w = w[:at] + w[at + 1 :]
                out.append(w)
            return " ".join(out)

        return pd.Series([one(t, k) for t, k in zip(text, key, strict=True)])

    return spoil(texts, keys.cast("string"))


def augmented(existing: DataFrame, more: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``existing`` pairs and, if they are fewer than ``n``, as many of ``more`` as are wanting, in shuffled order."""
    have = existing.count()
    if have >= n:
        return existing
    return assembled(existing, more.orderBy(lot("query", "passage", seed=seed), "query", "passage").limit(n - have), seed=seed)


def asked_of(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """query_id, query, ground_truth_id, ground_truth_text, work, category: the first halves of ``n`` sampled texts."""
    rows = sample_rows(docs, n, seed)
    return rows.select(F.col("doc_id").alias("query_id"), first_half(F.col("text")).alias("query"), F.col("doc_id").alias("ground_truth_id"), F.col("text").alias("ground_truth_text"), F.col("source").alias("work"), F.col("lang").alias("category"))


def ltr_groups(pairs: DataFrame) -> DataFrame:
    """Pairs of queries that have two or more, with graded relevance: 2 for easy positives, 1 for others, 0 for negatives."""
    many = F.count("*").over(Window.partitionBy("query"))
    relevance = F.when((F.col("label") == 1) & (F.col("difficulty") == "easy"), 2).when(F.col("label") == 1, 1).otherwise(0)
    return pairs.withColumn("group_size", many).filter("group_size >= 2").withColumn("relevance", relevance)
