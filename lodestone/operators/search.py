"""Indexes as tables, and retrieval of many queries at once by joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, whole
from . import scans

K1, B = 1.2, 0.75
WINDOW, OVERLAP = 10, 5
WEIGHTS = {"bm25": 0.6, "ngram": 0.4, "dense": 0.0}
# Synonyms of a query term.
SYNONYMS = {
    "viṣṇu": ["hari", "nārāyaṇa", "keśava", "madhusūdana", "govinda"],
    "śiva": ["maheśvara", "śaṅkara", "rudra", "īśa", "hara"],
    "brahmā": ["pitāmaha", "svayambhū", "prajāpati", "virañci"],
    "devī": ["ambā", "umā", "pārvatī", "śakti", "bhagavatī"],
    "rāja": ["nṛpa", "bhūpati", "bhūpāla", "mahīpati"],
    "veda": ["śruti", "nigama", "āgama"],
    "dharma": ["nyāya", "rita", "satya"],
    "artha": ["vitta", "dhana", "sampad"],
    "kāma": ["icchā", "vāsanā", "abhilāṣa"],
    "mokṣa": ["mukti", "nirvāṇa", "kaivalya", "apavarga"],
}


def corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text of a table, spread over the cores: one Parquet file is one split."""
    return docs.select(F.col(key).alias("doc_id"), whole(F.col(text)).alias("text"))


def asked(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    return queries.select(F.col(key).alias("query_id"), whole(F.col(text)).alias("query"))


def valid(docs: DataFrame, least: int = 10) -> DataFrame:
    return docs.filter(F.length(F.btrim(whole(F.col("text")), F.lit(" \t\n\x0b\x0c\r"))) > least)


def top(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", ties: str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query with their rank; a window limit keeps only those in each partition before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(ties))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# BM25


def term_counts(docs: DataFrame) -> DataFrame:
    """doc_id, dl, term, tf: the postings."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: n documents of avgdl words."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """May be negative, for terms in more than half of all documents."""
    return F.log((n - df + 0.5) / (df + 0.5))


def term_stats(docs: DataFrame) -> DataFrame:
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.crossJoin(F.broadcast(corpus_size(docs))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank of the best ``k`` documents with a term of the query.

    The queries go to the documents, and each task hands on its own best ``k``: see ``scans``.  A term that a query repeats counts as often.
    Where documents share an id, their rows are put together by joins.
    """
    if not scans.repeats_ids(docs):
        return top(scans.bm25_scan(docs, queries, k, k1, b), k)
    terms = wanted_terms(queries).select("term").distinct()
    words = docs.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    postings = words.join(terms, "term").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return weighed(postings, corpus_size(docs), wanted_terms(queries), k, k1, b)


def wanted_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25_of(postings: DataFrame, size: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """The same from the postings (doc_id, dl, term, tf) of all terms, and the one row of the corpus's size."""
    wanted = wanted_terms(queries)
    return weighed(postings.join(wanted.select("term").distinct(), "term", "left_semi"), size, wanted, k, k1, b)


def weighed(met: DataFrame, size: DataFrame, wanted: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    weighted = met.join(df, "term").crossJoin(F.broadcast(size))
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weighted.select("term", "doc_id", part.alias("part")).join(wanted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    return top(scored.withColumn("score", F.round("score", 9)), k)


# Character n-grams


def unspaced(text: Column) -> Column:
    return F.replace(F.lower(whole(text)), F.lit(" "), F.lit(""))


def grams(text: Column, n: int = 3) -> Column:
    """Different runs of ``n`` characters of the lower text without spaces."""
    return F.array_distinct(F.regexp_extract_all(unspaced(text), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def gram_index(docs: DataFrame, n: int = 3) -> DataFrame:
    g = docs.select("doc_id", grams(F.col("text"), n).alias("g"))
    return g.select("doc_id", F.size("g").alias("n_grams"), F.explode("g").alias("gram"))


def gram_search(docs: DataFrame, queries: DataFrame, k: int, n: int = 3) -> DataFrame:
    """The best ``k`` documents of each query by Jaccard similarity of their n-grams; only such as share one."""
    if n > 3 or scans.repeats_ids(docs):
        return gram_search_of(gram_index(docs, n), queries, k, n)
    return top(scans.gram_scan(docs.select("doc_id", unspaced(F.col("text")).alias("text")), queries.select("query_id", unspaced(F.col("query")).alias("query")), k, n), k)


def gram_search_of(index: DataFrame, queries: DataFrame, k: int, n: int = 3) -> DataFrame:
    """The same from the index (doc_id, n_grams, gram)."""
    q = queries.select("query_id", grams(F.col("query"), n).alias("g")).select("query_id", F.size("g").alias("q_grams"), F.explode("g").alias("gram"))
    both = index.join(q, "gram").groupBy("query_id", "doc_id", "q_grams", "n_grams").agg(F.count("*").alias("common"))
    return top(both.select("query_id", "doc_id", (F.col("common") / (F.col("q_grams") + F.col("n_grams") - F.col("common"))).alias("score")), k)


# Word windows


def window_index(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, start, end, words of every window, the last ones short."""
    words = docs.select("doc_id", tokens(F.lower("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(window - overlap))).alias("start")
    cut = words.select("doc_id", "w", starts)
    return cut.select("doc_id", "start", F.least(F.col("start") + window, F.size("w")).alias("end"), F.slice("w", F.col("start") + 1, window).alias("words"))


def word_ngrams(docs: DataFrame, low: int = 3, high: int = 20) -> DataFrame:
    """Every run of ``low`` to ``high`` words of the documents."""
    words = docs.select("doc_id", tokens(F.lower("text")).alias("w")).filter(F.size("w") >= low)
    sized = words.select("doc_id", "w", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.size("w")))).alias("n"))
    return sized.select("doc_id", "n", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("start")).select("doc_id", "n", "start", F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("gram"))


def partial_search(docs: DataFrame, queries: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, wide: bool = False, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score, at: the largest part of a query's words that stand in a document at the query's distances.

    Every offset of a query in a document is counted in the task that has the document: see ``scans``.  An offset counts if two neighbouring
    windows cover the query there; with ``wide``, a query longer than two windows counts wherever it fits in the document, as if the
    windows were as long as it needs, and else it has no match.  In a document of one window, an offset counts if all the query's words that the corpus has, its first among them, are in it.
    With ``k``, of each query at least its best ``k`` are there, as ``top`` orders them, and some of the others.
    """
    if scans.repeats_ids(docs):
        return partial_search_of(word_places(docs), queries, window, overlap, wide)
    low = docs.select("doc_id", F.lower(whole(F.col("text"))).alias("text"))
    asked_for = queries.select("query_id", F.lower(whole(F.col("query"))).alias("query"))
    many = scans.partial_scan(low, asked_for, window, overlap, wide, k)
    small = word_places(low).filter(F.col("n") <= window - overlap)
    return many.unionByName(partial_in_small(small, offsets_of(small, query_places(queries)), query_places(queries), scans.words_seen(low, asked_for)))


def word_places(docs: DataFrame) -> DataFrame:
    """doc_id, n, pos, word: every word of the lower text with its place, and how many there are."""
    words = docs.select("doc_id", tokens(F.lower("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))


def query_places(queries: DataFrame) -> DataFrame:
    qw = queries.select("query_id", tokens(F.lower("query")).alias("qw")).withColumn("qlen", F.size("qw"))
    return qw.select("query_id", "qlen", F.posexplode("qw").alias("qpos", "word"))


def offsets_of(d: DataFrame, q: DataFrame) -> DataFrame:
    return d.join(q, "word").groupBy("query_id", "doc_id", "qlen", "n", (F.col("pos") - F.col("qpos")).alias("at")).agg(F.count("*").alias("hits"))


def best_offset(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("query_id", "doc_id").agg(F.max(F.struct(F.col("hits") / F.col("qlen"), -F.col("at"))).alias("m")).select("query_id", "doc_id", F.col("m.col1").alias("score"), (-F.col("m.col2")).cast("int").alias("at"))


def partial_in_small(d: DataFrame, offsets: DataFrame, q: DataFrame, known: DataFrame) -> DataFrame:
    """Matches in the documents ``d`` of one window; ``known(word)`` has the words that any document has."""
    needs = q.join(known, "word", "left_semi").groupBy("query_id").agg(F.countDistinct("word").alias("needs"), F.max(F.when(F.col("qpos") == 0, 1).otherwise(0)).alias("has_first"))
    has = d.join(q, "word").groupBy("query_id", "doc_id").agg(F.countDistinct("word").alias("has"))
    whole_in = has.join(needs, "query_id").filter((F.col("has") == F.col("needs")) & (F.col("has_first") == 1)).select("query_id", "doc_id")
    return best_offset(offsets.filter((F.col("at") >= 0) & (F.col("at") + F.col("qlen") <= F.col("n"))).join(whole_in, ["query_id", "doc_id"], "left_semi"))


def partial_search_of(d: DataFrame, queries: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, wide: bool = False) -> DataFrame:
    """The same from the places (doc_id, n, pos, word)."""
    step = window - overlap
    q = query_places(queries)
    offsets = offsets_of(d, q)
    # The last pair of windows that starts no later than the offset reaches furthest.
    pair = F.least(F.floor(F.col("at") / step), F.ceil(F.col("n") / step) - 2)
    covered = (F.col("at") >= 0) & (F.col("at") + F.col("qlen") <= F.least((pair + 1) * step + window, F.col("n")))
    fits = covered & (F.col("qlen") <= 2 * window - overlap)
    if wide:
        fits = fits | ((F.col("qlen") > 2 * window - overlap) & (F.col("at") >= 0) & (F.col("at") + F.col("qlen") <= F.col("n")))
    few = partial_in_small(d.filter(F.col("n") <= step), offsets.filter(F.col("n") <= step), q, d.select("word").distinct())
    # A document that has rows of several lengths, as where ids repeat, may be in both.
    both = best_offset(offsets.filter((F.col("n") > step) & fits)).unionByName(few)
    return both.groupBy("query_id", "doc_id").agg(F.max(F.struct("score", -F.col("at"))).alias("m")).select("query_id", "doc_id", "m.score", (-F.col("m.col2")).cast("int").alias("at"))


def match_context(docs: DataFrame, hits: DataFrame, reach: int = 5) -> DataFrame:
    """The words from ``reach`` before to ``reach`` after the place of each hit."""
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    low = F.greatest(F.lit(0), F.col("at") - reach)
    return hits.join(words, "doc_id").select("query_id", "doc_id", "at", F.array_join(F.slice("w", low + 1, F.least(F.size("w"), F.col("at") + reach) - low), " ").alias("context"))


# Dense vectors


#: Queries with vectors that go to every task together.
SENT = 2048


def cosine_search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best ``k`` vectors (doc_id, v) for each query (query_id, q); of equal ones the larger id.

    All pairs are looked at, in blocks of up to ``SENT`` queries, as products of matrices: see ``scans``.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    pieces = vectors._jdf.queryExecution().toRdd().getNumPartitions()
    scored = scans.cosine_scan(vectors if pieces >= cores else vectors.repartition(cores), queries, k, SENT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# Expansion and fusion


def expand_synonyms(queries: DataFrame, table: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """query_id, variant: the query, and for each synonym of a key that its lower form contains that form with the synonym."""
    low = F.lower("query")
    lists = [F.when(F.contains(low, F.lit(k)), F.array(*[F.replace(low, F.lit(k), F.lit(s)) for s in ss])).otherwise(F.array().cast("array<string>")) for k, ss in table.items()]
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(F.array("query"), *lists))).alias("variant"))


def fused_search(docs: DataFrame, queries: DataFrame, k: int, table: dict[str, list[str]] = SYNONYMS, weights: dict[str, float] = WEIGHTS, use_partial: bool = True, variants: DataFrame | None = None, wide: bool = False, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """query_id, doc_id, score, base, partial, rank: BM25 and n-grams of all variants of a query, and partial matches of the query itself.

    Each variant's list of 2k is divided by its greatest score and weighted; an index of weight 0 is not searched.  What
    both find counts 0.7 of the one and 0.5 of the other, what only the partial search finds 0.8 of that.  With the tables of ``index_tables`` no text is read.
    """
    index = index or {}
    named = (variants or expand_synonyms(queries, table)).withColumn("variant_id", F.struct("query_id", "variant"))
    many = named.groupBy("query_id").agg(F.count("*").alias("n_variants"))
    each = named.select(F.col("variant_id").alias("query_id"), F.col("variant").alias("query"))
    lists = [
        (bm25_of(index["postings"], index["size"], each, 2 * k) if index else bm25(docs, each, 2 * k), weights["bm25"]),
        (gram_search_of(index["grams"], each, 2 * k) if index else gram_search(docs, each, 2 * k), weights["ngram"]),
    ]
    best = Window.partitionBy("query_id")
    parts = None
    for found, weight in lists:
        if weight:
            most = F.max("score").over(best)
            part = found.select(F.col("query_id.query_id").alias("query_id"), "doc_id", (F.lit(weight) * F.col("score") / F.when(most == 0, 1.0).otherwise(most)).alias("part"))
            parts = part if parts is None else parts.unionByName(part)
    base = parts.join(many, "query_id").groupBy("query_id", "doc_id").agg(F.sum(F.col("part") / F.col("n_variants")).alias("base"))
    if not use_partial:
        return top(base.select("query_id", "doc_id", F.round("base", 6).alias("score"), F.round("base", 6).alias("base"), F.lit(None).cast("double").alias("partial")), k)
    found = (partial_search_of(index["places"], queries, wide=wide) if index else partial_search(docs, queries, wide=wide)).filter("score > 0").select("query_id", "doc_id", F.col("score").alias("partial"))
    score = F.when(F.col("partial").isNull(), F.col("base")).when(F.col("base").isNull(), F.col("partial") * 0.8).otherwise(F.col("base") * 0.7 + F.col("partial") * 0.5)
    rows = lambda df: df.select("query_id", "doc_id", F.round(score, 6).alias("score"), F.round("base", 6).alias("base"), F.round("partial", 6).alias("partial"))
    # What the lists have is little; of what only the partial search finds, each task keeps the best k before the shuffle.  A row that both have is a group by itself.
    base = base.persist()
    met = found.join(scans.few(base, queries), ["query_id", "doc_id"], "left").withColumn("listed", F.when(F.col("base").isNotNull(), F.struct("doc_id")))
    best = Window.partitionBy("query_id", "listed").orderBy(F.desc(F.round(F.col("partial") * 0.8, 6)), "doc_id")
    met = met.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).persist()
    listed = base.join(met.select("query_id", "doc_id", "partial"), ["query_id", "doc_id"], "left")
    alone = met.filter("base IS NULL").select("query_id", "doc_id", "base", "partial")
    return top(rows(listed.select("query_id", "doc_id", "base", "partial").unionByName(alone)), k)


def words_with(words: DataFrame, terms: DataFrame) -> DataFrame:
    """word, term for every word of ``words(word)`` that has a term of ``terms(term)`` inside it.

    A word meets the terms that begin with one, two or three characters in a row that it has, terms of one or two characters being
    these themselves; only then is looked for the whole term.
    """
    run = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))), lambda k: F.substring("word", k, F.lit(n)))
    grams = words.select("word", F.explode(F.array_distinct(F.concat(run(1), run(2), run(3)))).alias("gram"))
    asked_for = terms.select("term", F.substring("term", 1, 3).alias("gram"))
    return grams.join(asked_for, "gram").filter(F.contains("word", F.col("term"))).select("word", "term")


def index_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """What the searches need of a corpus, each sorted by what they look for: postings, the corpus's size, grams and places of words."""
    by = lambda df, key: df.repartition(key).sortWithinPartitions(key, "doc_id")
    return {"postings": by(term_counts(docs), "term"), "size": corpus_size(docs), "grams": by(gram_index(docs), "gram"), "places": by(word_places(docs), "word")}


def simple_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Query terms as words count 2, inside words 1; several found terms raise the score, long texts lower it.

    A term has no gap, so what has it in the text has it in a word: the task that has a document looks for the terms inside its different words, and
    remembers what words have inside.  Where documents share an id, terms meet the words of the corpus in joins.
    """
    if not scans.repeats_ids(docs):
        low = docs.select("doc_id", F.lower(whole(F.col("text"))).alias("text"))
        return top(scans.simple_scan(low, queries.select("query_id", F.lower(whole(F.col("query"))).alias("query")), k), k)
    return simple_search_joined(docs, queries, k)


def simple_search_joined(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same by joins."""
    asked_for = queries.select("query_id", tokens(F.lower("query")).alias("terms")).select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).groupBy("query_id", "n_terms", "term").agg(F.count("*").alias("times"))
    words = docs.select("doc_id", tokens(F.lower("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.explode(F.array_distinct("w")).alias("word"))
    met = words_with(words.select("word").distinct(), asked_for.select("term").distinct())
    points = F.max(F.when(F.col("word") == F.col("term"), 2.0).otherwise(1.0)).alias("points")
    has = words.join(met, "word").groupBy("doc_id", "n", "term").agg(points)
    sums = has.join(asked_for, "term").groupBy("query_id", "doc_id", "n", "n_terms").agg(F.sum(F.col("points") * F.col("times")).alias("total"), F.sum("times").cast("int").alias("found"))
    boost = F.when((F.col("n_terms") > 1) & (F.col("found") > 1), 1 + 0.2 * F.col("found")).otherwise(1.0)
    return top(sums.select("query_id", "doc_id", F.round(F.col("total") * boost / (1 + F.col("n") / 100), 6).alias("score")).filter("score > 0"), k)


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents whose text has that of ``items(query_id, item)`` in it.

    Items go to the documents: see ``scans``.  An item without words is in every document that has its white space, and left out.
    """
    return scans.holding_scan(docs, items.select("query_id", F.col("item").alias("query"))).select("query_id", "doc_id")


def overlap_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score: the part of a query's different words that a document has, where it has one."""
    q = queries.select("query_id", F.array_distinct(tokens(F.lower("query"))).alias("qw")).select("query_id", F.size("qw").alias("n"), F.explode("qw").alias("word"))
    d = docs.select("doc_id", F.explode(F.array_distinct(tokens(F.lower("text")))).alias("word"))
    return d.join(q, "word").groupBy("query_id", "doc_id", "n").agg((F.count("*")).alias("common")).select("query_id", "doc_id", (F.col("common") / F.col("n")).alias("score"))


def three_stages(docs: DataFrame, queries: DataFrame, first: int = 10, second: int = 3) -> DataFrame:
    """Overlap, then substring and length, then a verdict: query_id, doc_id, rank, s1, s2, match, confidence."""
    s1 = top(overlap_scores(docs, queries), first).select("query_id", "doc_id", F.col("score").alias("s1"))
    full = scans.few(s1, queries).join(docs, "doc_id").join(queries, "query_id")
    ratio = F.least(F.length("query"), F.length("text")) / F.greatest(F.length("query"), F.length("text"))
    s2 = F.col("s1") + 0.5 * F.contains(F.lower("text"), F.lower("query")).cast("int") + 0.3 * F.coalesce(F.try_divide(ratio, F.lit(1.0)), F.lit(0.0))
    ranked = top(full.select("query_id", "doc_id", F.round("s1", 6).alias("s1"), F.round(s2, 6).alias("s2")), second, "s2")
    return ranked.withColumns({"match": F.col("s2") > 0.7, "confidence": F.least("s2", F.lit(1.0))})


def llm_first(hits: DataFrame) -> DataFrame:
    """Hits with a score by a model first, the best of them first, then the others by their own score."""
    order = Window.partitionBy("query_id").orderBy(F.col("llm_score").isNull(), F.desc("llm_score"), F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order))
