"""Jobs that grow no faster than their tables: how much they shuffle, and rows equal to those of joins."""

import random

from against_sql import SMALL
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import graph, models, pairs, runs, scans, search


def shuffled(spark, df) -> float:
    """MB that the session's tasks write for other tasks while ``df`` is computed."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda s: [s.apply(k) for k in range(s.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    before = written()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return (written() - before) / 1e6


def rows(df):
    return sorted(map(str, df.collect()))


def crowded(spark, seed=3):
    """Documents of few different words, some of one window, and more queries than go to the tasks together."""
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("ab cd ef gh Ij".split()) for _ in range(n))
    docs = [(k, text(r.choice([0, 1, 3, 5, 6, 9, 30, 400]))) for k in range(60)] + [(None, "ab cd ef gh ij ab cd"), (900, None), (901, "ab cd\tef")]
    asked = [(k, text(r.choice([0, 1, 2, 4, 12, 15, 16, 40]))) for k in range(30)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")


def test_partial_matches_stay_in_their_task(spark, monkeypatch):
    docs, asked = crowded(spark)
    docs = search.corpus(docs)
    for wide in (False, True):
        joined = rows(search.partial_search_of(search.word_places(docs), asked, wide=wide))
        assert rows(search.partial_search(docs, asked, wide=wide)) == joined
        best = search.top(search.partial_search_of(search.word_places(docs), asked, wide=wide), 3)
        monkeypatch.setattr(scans, "SENT", 7)
        monkeypatch.setattr(scans, "PLACES", 50)
        monkeypatch.setattr(scans, "HELD", 40)
        assert rows(search.partial_search(docs, asked, wide=wide)) == joined
        assert rows(search.top(search.partial_search(docs, asked, wide=wide, k=3), 3)) == rows(best)
        monkeypatch.undo()
    twice = docs.unionByName(docs.filter("doc_id < 20").withColumn("text", F.concat("text", F.lit(" ab cd")))).filter("doc_id IS NOT NULL")
    assert rows(search.partial_search(twice, asked)) == rows(search.partial_search_of(search.word_places(twice), asked))
    corpus, quotes = queries.corpus_of(spark, SMALL), queries.quotes_of(spark, SMALL)
    assert shuffled(spark, search.partial_search(corpus, quotes, wide=True)) < 2
    assert shuffled(spark, queries.match_context(spark, SMALL)) < 4


def test_fused_lists_stay_in_their_tasks(spark, monkeypatch):
    """the fused search against that on index tables, which are joined."""
    docs, asked = crowded(spark, 8)
    docs = search.corpus(docs.filter("doc_id IS NOT NULL"))
    table = {"ab ": ["gh ", "cd "], "cd": ["ef"]}
    index = search.index_tables(docs)
    for k in (2, 50):
        joined = rows(search.fused_search(docs, asked, k, table, wide=True, index=index))
        assert rows(search.fused_search(docs, asked, k, table, wide=True)) == joined
        monkeypatch.setattr(scans, "SENT", 9)
        assert rows(search.fused_search(docs, asked, k, table, wide=True)) == joined
        monkeypatch.undo()
    assert shuffled(spark, queries.fused_search(spark, SMALL)) < 2


def test_lists_of_many_queries(spark, monkeypatch):
    """BM25 and n-grams in blocks of queries, with null ids, equal scores and ids of two rows, against joins."""
    docs, asked = crowded(spark, 4)
    docs = search.corpus(docs)
    joined = lambda d, k: rows(search.bm25_of(search.term_counts(d), search.corpus_size(d), asked, k))
    for d in (docs, docs.filter("doc_id > 40"), docs.filter("doc_id = 900")):
        for k in (1, 5, 500):
            assert rows(search.bm25(d, asked, k)) == joined(d, k)
            assert rows(search.gram_search(d, asked, k)) == rows(search.gram_search_of(search.gram_index(d), asked, k))
    few = joined(docs, 5), rows(search.gram_search(docs, asked, 5))
    monkeypatch.setattr(scans, "SENT", 4)
    monkeypatch.setattr(scans, "HELD", 20)
    assert (rows(search.bm25(docs, asked, 5)), rows(search.gram_search(docs, asked, 5))) == few
    monkeypatch.undo()
    twice = docs.unionByName(docs.limit(9))
    assert rows(search.bm25(twice, asked, 5)) == joined(twice, 5)
    assert rows(search.gram_search(docs, asked, 5, 4)) == rows(search.gram_search_of(search.gram_index(docs, 4), asked, 5, 4))
    assert shuffled(spark, queries.bm25_topk(spark, SMALL)) < 0.6


def test_terms_are_counted_length_by_length(spark):
    """frequent runs of words and characters against counts of every run, with few and with many repeats."""
    docs, asked = crowded(spark, 6)
    small = search.corpus(spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 60"))
    held = small.filter("length(text) > 40").limit(12).select(F.col("doc_id").alias("query_id"), F.substring("text", 5, 300).alias("query"))
    for corpus, quotes in ((search.corpus(docs.filter("doc_id IS NOT NULL")), asked), (small, held)):
        p = quotes.limit(10).crossJoin(corpus.filter("doc_id % 3 = 0"))
        choices = {**pairs.ADVANCED_CHOICES, "a": ("words", 1, 2, 7), "b": ("words", 2, 3, 3), "c": ("chars", 3, 5, 40), "d": ("words", 3, 4, 50), "e": ("chars", 4, 6, 9)}
        made = pairs.with_similarities(p, corpus, choices).persist()
        for name, choice in choices.items():
            joined = pairs.weighted_similarity_joined(p, corpus, choice[3], pairs.of_choice(choice))
            assert rows(made.select("query_id", "doc_id", F.col(name).alias("similarity"))) == rows(joined), (name, choice)
        assert rows(pairs.weighted_search(corpus, quotes, 4)) == rows(pairs.weighted_search_joined(corpus, quotes, 4))
    twice = small.unionByName(small.limit(5))
    assert rows(pairs.weighted_search(twice, held, 4)) == rows(pairs.weighted_search_joined(twice, held, 4))
    assert shuffled(spark, queries.advanced_features_all(spark, SMALL)) < 10
    assert shuffled(spark, queries.weighted_topk(spark, SMALL)) < 4


def test_chosen_terms_within_bounds(spark, monkeypatch):
    corpus, quotes = queries.corpus_of(spark, SMALL).filter("doc_id < 30"), queries.quotes_of(spark, SMALL)
    sent = rows(pairs.weighted_search(corpus, quotes, 3))
    monkeypatch.setattr(runs, "HELD", 50)  # counts go on in many pieces
    assert rows(pairs.weighted_search(corpus, quotes, 3)) == sent
    monkeypatch.setattr(runs, "MOST", 10)  # too many runs for the driver
    assert rows(pairs.weighted_search(corpus, quotes, 3)) == sent


def test_boosting_takes_all_rounds(spark, monkeypatch):
    """F15."""
    import inspect

    asked, fit = {}, models.fit_boosted

    def short(*args, **more):
        bound = inspect.signature(fit).bind(*args, **more)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return fit(*args, **more | {"rounds": 1})

    monkeypatch.setattr(models, "fit_boosted", short)
    assert queries.gbt_rank(spark, SMALL).count() > 0
    assert (asked["rounds"], asked["depth"], asked["held"]) == (200, 6, None)


def test_terms_inside_words_and_vectors(spark, monkeypatch):
    """against joins, and against every pair; equal vectors by the larger id."""
    docs, asked = crowded(spark, 5)
    docs = search.corpus(docs.filter("doc_id IS NOT NULL").withColumn("text", F.translate("text", " ", "  ")).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "b c", "bé世c")).otherwise(F.col("text"))))
    asked = asked.unionByName(spark.createDataFrame([(98, "a b bé世 abcdefg Cd d e世c"), (99, "bé世cd bé世cdef é")], asked.schema))
    for k in (3, 500):
        assert rows(search.simple_search(docs, asked, k)) == rows(search.simple_search_joined(docs, asked, k))
    assert shuffled(spark, queries.simple_search(spark, SMALL)) < 1
    r = random.Random(2)
    few = [[float(r.randint(-2, 2)) for _ in range(3)] + [1.0] for _ in range(25)]
    v = [(k, few[r.randrange(25)]) for k in range(200)]
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)
    expected = {(q, d, n + 1) for q, qv in v[::20] for n, (_, d) in enumerate(sorted(((cos(qv, dv), d) for d, dv in v), reverse=True)[:30])}
    vectors = spark.createDataFrame(v, "doc_id long, v array<float>")
    got = search.cosine_search(vectors, vectors.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), 30)
    assert {(x.query_id, x.doc_id, x["rank"]) for x in got.collect()} == expected
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_small_tables_go_to_the_texts(spark):
    """No text and no word of one is shuffled to meet a lexicon, a few items or a few hits."""
    names, _, _ = queries.graph_of(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert shuffled(spark, graph.mentions(docs, names)) < 0.1
    assert shuffled(spark, queries.truth_of(spark, SMALL)) < 0.6
    hits = spark.createDataFrame([(1, 3, 0)], "query_id long, doc_id long, at int")
    assert shuffled(spark, search.match_context(docs, scans.few(hits, hits))) < 0.01
