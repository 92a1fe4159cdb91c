"""Values worked out by hand."""

import random

from pyspark.sql import functions as F

from lodestone.functions import metadata, text
from lodestone.operators import graph, metrics, pairs, search
from lodestone.plans.engine import Engine

VERSES = [
    "somasyātha bṛhaspateḥ śaner guroś ca sarve grahāḥ śāntikarā bhavantu",
    "dharmo rakṣati rakṣitaḥ satyaṃ vada dharmaṃ cara svādhyāyān mā pramadaḥ",
]


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_graph_score(spark):
    names, edges = graph.lexicon(spark), graph.with_inverse(graph.relations(spark))
    works = graph.works_of(spark)
    queries = spark.createDataFrame([(1, "kṛṣṇa arjuna")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "kṛṣṇa uvāca pārtha"), (2, "dharmo rakṣati rakṣitaḥ"), (3, "rāmo rājavaraḥ")], "doc_id long, text string")
    hits = spark.createDataFrame([(1, 1, 0.75), (1, 2, 0.8), (1, 3, 0.7)], "query_id long, doc_id long, score double")
    features = graph.pair_features(hits, queries, docs, names, edges, works)
    got = {r.doc_id: (round(r.kg_score, 7), r.combined_score) for r in graph.rerank(hits, features).collect()}
    assert got == {1: (0.2142857, 0.589286), 2: (0.0, 0.56), 3: (0.0, 0.49)}
    assert edges.count() == 46


def test_expansion_by_graph(spark):
    names, edges = graph.lexicon(spark), graph.with_inverse(graph.relations(spark))
    queries = spark.createDataFrame([(1, "viṣṇu stuti"), (2, "dharma rakṣati"), (3, "arjuna yuddha")], "query_id long, query string")
    got = {(r.query_id, r.variant) for r in graph.expand_by_graph(queries, names, edges).collect()}
    assert got == {(1, "viṣṇu stuti"), (1, "kṛṣṇa stuti"), (1, "rāma stuti"), (1, "viṣṇu stuti lakṣmī"), (2, "dharma rakṣati"), (3, "arjuna yuddha")}


def test_partial_matches(spark):
    docs = spark.createDataFrame(list(enumerate(VERSES)), "doc_id long, text string")
    queries = spark.createDataFrame([(0, "somasyātha bṛhaspateḥ"), (1, "dharmo rakṣati"), (2, "rakṣati rakṣitaḥ"), (3, "nobody knows")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in search.partial_search(docs, queries).filter("score = 1").collect()}
    assert got == {(0, 0): 1.0, (1, 1): 1.0, (2, 1): 1.0}


def test_partial_against_windows(spark):
    """Against a brute force over every pair of neighbouring windows, in texts of few words."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("abc") for _ in range(r.randint(11, 40)))) for i in range(30)]
    queries = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 16)))) for i in range(12)]
    expected = {}
    for q, qt in queries:
        qw = qt.split()
        for d, dt in docs:
            w, best = dt.split(), 0
            starts = list(range(0, len(w), 5))
            for s, nxt in zip(starts, starts[1:]):
                joined = w[s : min(nxt + 10, len(w))]
                for o in range(len(joined) - len(qw) + 1):
                    best = max(best, sum(a == b for a, b in zip(qw, joined[o:])) / len(qw))
            if best:
                expected[q, d] = round(best, 9)
    got = search.partial_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"))
    assert {(x.query_id, x.doc_id): round(x.score, 9) for x in got.collect()} == expected


def test_confirmation(spark):
    rows = [(1, 1, "dharma viṣṇu", "BG dharma viṣṇu priya //BG_4.7//", "x", "y"), (1, 2, "dharma viṣṇu", "nothing", "x", "y")]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, query string, text string, work string, category string")
    got = pairs.keep_confirmed(pairs.confirmed(hits), 5).collect()
    assert [(r.doc_id, r.match, r.confidence, r.predicted_verse) for r in got] == [(1, True, 1.0, "BG_4.7")]


def test_text(spark):
    assert one(spark, text.normal_form, "Kṛṣṇa  UVĀCA\n") == "krsna uvaca"
    assert one(spark, text.cleaned, " a1  <b>c</b>&nbsp; d।") == "a c d"
    assert one(spark, text.script, "धर्म") == "devanagari"
    assert one(spark, lambda c: text.split_compounds(c), "pramada devatvatva a") == ["pra", "mada", "devatva", "tva", "a"]
    assert text.to_iast("धर्मक्षेत्रे", "devanagari") == "dharmakṣetre"
    assert text.to_iast("kRSNa", "hk") == "kṛṣṇa"
    assert one(spark, lambda c: text.to_nfc(c), "ā") == "ā"
    got = spark.createDataFrame([("sa_mbh_01.htm", "x"), ("", ""), ("zzz.htm", "purana"), ("zz_BndP", "")], "n string, c string").select(metadata.work_of(F.col("n"), F.col("c")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in got] == [("Mahabharata", "Vyasa", "X"), ("Unknown", "Unknown", "Unknown"), ("Sanskrit Text", "Unknown", "Purana"), ("Brahmanda Purana", "Vyasa", "Purana")]


def test_subsequence_and_runs(spark):
    r = random.Random(3)
    rows = [(k, k, " ".join(r.choice("abcd") for _ in range(r.randint(0, 12))), " ".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for k in range(40)]

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    def run(a, b):
        return max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + n] == b[j : j + n]), default=0)

    df = spark.createDataFrame(rows, "query_id long, doc_id long, query string, text string")
    got = {x.query_id: x.l for x in df.select("query_id", pairs.common_subsequence(pairs.words_of(F.col("query")), pairs.words_of(F.col("text"))).alias("l")).collect()}
    assert got == {k: lcs(a.split(), b.split()) for k, _, a, b in rows}
    assert {x.query_id: x.run for x in pairs.longest_run(df).collect()} == {k: run(a.split(), b.split()) for k, _, a, b in rows}


def test_measures(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.9), (2, 0, 0.1), (2, 1, 0.4)], "query_id long, label int, score double")
    assert metrics.auc(scored).first()["auc"] == 0.625
    assert metrics.auc(scored.filter("label = 1")).first()["auc"] == 0.5
    row = metrics.classification(scored).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.5, 0.5, 0.5)


def test_engine_finds_its_quotes(spark):
    docs = spark.createDataFrame([(k, v, "w", "c") for k, v in enumerate(VERSES)], "doc_id long, text string, source string, lang string")
    engine = Engine(spark, docs)
    queries = spark.createDataFrame([(0, "dharmo rakṣati rakṣitaḥ satyaṃ")], "query_id long, query string")
    hit = engine.retrieve(queries).first()
    assert (hit.doc_id, hit.match) == (1, True)
    assert engine.stats().first()["n_docs"] == 2 and engine.health()["indexed"]


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None), (2, "", "s", "l"), (None, "alpha beta gamma delta", "s", "l")], "doc_id long, text string, source string, lang string")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, None)], "query_id long, query string")
    c = search.corpus(docs)
    assert [r.doc_id for r in search.bm25(c, queries.na.fill(""), 5).collect()] == [None]
    assert search.gram_search(c, queries, 5).count() == 1
    assert search.window_index(c).count() == 1
    assert search.bm25(c.limit(0), queries, 5).count() == 0


def test_lexicon_and_mentions(spark):
    import re

    names = graph.lexicon(spark)
    assert [len({v for vs in t.values() for v in vs}) for t in graph.LEXICON.values()] == [99, 52, 50, 49, 27]
    texts = ["Śaṅkara uvāca: pavana-tanaya, rāmasya bhaktaḥ!", "kṛṣṇa-kṛṣṇa VEDAVYĀSAḤ vyāsaḥ", "rāma_x xrāma rāma", "", None, "  ādikāvye rāmāyaṇe — mukti, dharmakṣetre kurukṣetre"]
    expected = set()
    for k, t in enumerate(texts):
        for etype, table in graph.LEXICON.items():
            variants = sorted({v for vs in table.values() for v in vs}, key=len, reverse=True)
            for m in re.finditer(r"\b(" + "|".join(map(re.escape, variants)) + r")\b", t or "", re.IGNORECASE):
                canonical = next(c for c, vs in table.items() if m.group().lower() in vs)
                expected.add((k, etype, canonical, m.group().lower(), m.start(), m.end()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = graph.mentions(docs, names)
    assert {(r.doc_id, r.etype, r.canonical, r.matched, r.start, r.end) for r in graph.with_offsets(found, docs).collect()} == expected


def test_overlapping_variants(spark):
    names = spark.createDataFrame([("works", 0, "ab", "a b"), ("works", 1, "bc", "b c"), ("works", 2, "c", "c"), ("works", 3, "a", "a"), ("sages", 0, "b", "b")], "etype string, canon_ord int, canonical string, variant string")
    docs = spark.createDataFrame([(1, "a b c, b c a")], "doc_id long, text string")
    got = sorted((r.etype, r.canonical, r["at"]) for r in graph.mentions(docs, names).collect())
    assert got == [("sages", "b", 1), ("sages", "b", 3), ("works", "a", 5), ("works", "ab", 0), ("works", "bc", 3), ("works", "c", 2)]


def test_graph_round_trip(spark, tmp_path):
    edges, works, titles = graph.with_inverse(graph.relations(spark)), graph.works_of(spark), graph.titles_of(spark)
    graph.save_graph(str(tmp_path), edges=edges, works=works, titles=titles)
    back = graph.load_graph(spark, str(tmp_path), edges="src string, rel string, dst string, edge_ord int", works="entity string, work string", titles="work string, title string, author string")
    for name, df in {"edges": edges, "works": works, "titles": titles}.items():
        assert sorted(back[name].collect()) == sorted(df.select(*back[name].columns).collect())
    report = {r.entity: r for r in graph.entity_context(spark.createDataFrame([("rāma",), ("yoga",), ("nobody",)], "entity string"), back["edges"], back["works"], back["titles"], graph.concepts_of(spark)).collect()}
    assert [(x.rel, x.neighbour) for x in report["rāma"].relations][:2] == [("avatar_of", "viṣṇu"), ("has_devotee", "hanumān")]
    assert report["rāma"].works == ["rāmāyaṇa"] and report["rāma"].work_details[0].title == "Rāmāyaṇa"
    assert "jñānayoga" in report["yoga"].related_concepts and report["nobody"].relations == []
    queries = spark.createDataFrame([(1, "kṛṣṇa vyāsa"), (2, "yoga")], "query_id long, query string")
    got = {(r.query_id, r.variant) for r in graph.expand_by_graph(queries, graph.lexicon(spark), edges, spark.createDataFrame([("viṣṇu", "bhāgavata"), ("vyāsa", "bhāgavata"), ("vyāsa", "mahābhārata")], "entity string, work string"), titles).collect()}
    assert (1, "kṛṣṇa vyāsa Śrīmad Bhāgavata Purāṇa") in got and not any("Mahābhārata" in v for _, v in got) and {v for q, v in got if q == 2} == {"yoga"}
