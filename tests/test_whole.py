"""Whole jobs: rows that earlier versions left out."""

from against_sql import SMALL
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.operators import datasets, search
from lodestone.operators.pairs import difficulty


def test_pairs_of_all_documents(spark):
    docs = spark.createDataFrame([(9, "i i"), (1, "a a"), (7, "g g"), (7, "f f"), (None, "z z"), (2**40, "k k")], "doc_id long, text string")
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, digest(r.text)))
    expected = {(a.doc_id, a.text, b.text) for a, b in zip(order, order[1:] + order[:1])}
    assert {tuple(r) for r in datasets.with_next(docs).select("doc_id", "text", "next_text").collect()} == expected
    assert [r.next_text for r in datasets.with_next(docs.filter("doc_id = 9")).collect()] == [None]
    pairs = queries.all_pairs(spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) > 0").count()
    assert {(r["label"], r["count"]) for r in pairs.groupBy("label").count().collect()} == {(0, n), (1, n)}
    assert queries.learning_rows(spark, SMALL).filter("query_id % 5 <> 0").count() > 0


def digest(text):
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def test_long_quotes(spark):
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20]))], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(words[7:47])), (2, " ".join([*words[3:20], "x", *words[21:40]])), (3, " ".join(words[2:12]))], "query_id long, query string")
    got = {(r.query_id, r.doc_id): (round(r.score, 6), r["at"]) for r in search.partial_search(docs, asked, wide=True).collect()}
    assert got == {(1, 1): (1.0, 7), (2, 1): (round(36 / 37, 6), 3), (3, 1): (1.0, 2), (3, 2): (1.0, 2)}
    assert {tuple(r) for r in queries.synonym_expand(spark, SMALL).join(queries.quotes_of(spark, SMALL), "query_id").filter("variant = query").select("query_id").collect()} == {(r.item_id,) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}


def test_ngrams_of_long_documents(spark):
    texts = {1: " ".join(f"W{k % 211}" for k in range(500)), 2: "w1 w2  w3 w4", 3: "a b"}
    expected = {}
    for i, t in texts.items():
        w = t.lower().split()
        for n in range(3, 21):
            for k in range(len(w) - n + 1):
                expected.setdefault(" ".join(w[k : k + n]), set()).add(i)
    grams = search.word_ngrams(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {(r.gram, r.n) for r in grams.groupBy("gram").agg(F.countDistinct("doc_id").alias("n")).collect()}
    assert got == {(g, len(ids)) for g, ids in expected.items()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) >= 14").collect()}
    assert {r.doc_id for r in queries.exact_match_exhaustive(spark, SMALL).select("doc_id").distinct().collect()} == docs


def test_positive_pairs_of_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = {r.doc_id for r in docs.collect() if len((r.text or "").split()) >= 4}
    assert {r.doc_id for r in queries.positive_pairs(spark, SMALL).select("doc_id").distinct().collect()} == long
    few = docs.filter("length(text) < 1500").limit(20)
    wrong = datasets.positive_pairs(few).filter(difficulty(F.col("query"), F.col("passage")) != F.col("difficulty"))
    assert wrong.count() == 0 and datasets.positive_pairs(few).count() > 0


def test_hard_negatives_are_complete(spark):
    """Skewed works: every anchor has two of each kind wherever there are two, against a brute force over all texts."""
    rows = [(k, f"text {k % 90} " + "x" * (k % 40), "big" if k % 10 else f"s{k % 3}", "l1" if k % 4 else "l2") for k in range(200)] + [(300, "y" * 900, "lone", "l3"), (301, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {}
    for r in datasets.hard_negatives(docs, docs).collect():
        got.setdefault((r.doc_id, r.kind), set()).add(r.other_id)
    by_id = {r[0]: r for r in rows}
    for a in rows:
        if a[1] is None:
            continue
        others = [b for b in rows if b[1] is not None and b[1] != a[1]]
        fits = {"same_work": {b[1] for b in others if b[2] == a[2]}, "same_category": {(b[1], b[2]) for b in others if b[3] == a[3] and b[2] != a[2]}, "similar_length": {b[1] for b in others if 0.7 * len(a[1]) <= len(b[1]) <= 1.3 * len(a[1])}}
        for kind, able in fits.items():
            mine = got.get((a[0], kind), set())
            assert len(mine) == min(2, len(able)), (a, kind, mine)
            assert all(by_id[i][1] in able or (by_id[i][1], by_id[i][2]) in able for i in mine)
        chosen = [i for (d, _), ids in got.items() if d == a[0] for i in ids]
        assert all(by_id[i][1] != a[1] for i in chosen) and len(chosen) == 6


def test_simple_search_and_holding(spark):
    """Against a look at every text for every term."""
    import random

    r = random.Random(9)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    docs = [(k, "\t".join(word() for _ in range(r.randint(0, 30)))) for k in range(60)] + [(99, None)]
    asked = [(k, " ".join(word() for _ in range(r.randint(0, 4)))) for k in range(25)]
    expected = {}
    for q, t in asked:
        terms = t.lower().split()
        for d, text in docs:
            w = (text or "").split()
            points = [2.0 if x in w else 1.0 if x in (text or "") else 0.0 for x in terms]
            found = sum(p > 0 for p in points)
            if found:
                expected[q, d] = round(sum(points) * (1 + 0.2 * found if len(points) > 1 and found > 1 else 1) / (1 + len(w) / 100), 6)
    corpus = search.corpus(spark.createDataFrame(docs, "doc_id long, text string"))
    got = search.simple_search(corpus, spark.createDataFrame(asked, "query_id long, query string"), 1000)
    assert {(x.query_id, x.doc_id): x.score for x in got.collect()} == expected
    items = [(k, d[1][a : a + n]) for k, (d, a, n) in enumerate((r.choice(docs[:60]), r.randint(0, 9), r.randint(1, 25)) for _ in range(40))]
    held = {(k, d) for k, t in items for d, text in docs if t.split() and t in (text or "")}
    assert {tuple(x) for x in search.holding(corpus, spark.createDataFrame(items, "query_id long, item string")).collect()} == held


def test_graph_queries_within_little_memory():
    # In a session of its own: its sorts and aggregates take pages of a power of two, and at this size a task has few of them.
    import os
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config(map={{"spark.driver.memory": "1200m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}}).getOrCreate()
from lodestone import queries
print("ROWS", *[len(queries.QUERIES[n](spark, "{SMALL}").collect()) for n in ("kg_rerank", "kg_features")])
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert "ROWS 200 200" in found.stdout, found.stderr[-2000:]
