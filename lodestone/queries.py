"""The registered queries on the test tables, each with the same in SQL where SQL can say it.

documents stand for passages (source for work, lang for category), benchmark for quotes whose source is
sought, and conversations for a log of user queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metadata, text
from .operators import answers, datasets, graph, metrics, models, pairs, scans, search, testsets
from .plans.engine import Engine
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; where they lie in fewer pieces than there are cores, as one small file does, they are dealt out to these first."""
    return spread(table(spark, sf_dir, "documents"))


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if pieces >= cores else df.repartition(cores)


def corpus_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.corpus(docs_of(spark, sf_dir))


def quotes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, whole."""
    return search.asked(table(spark, sf_dir, "benchmark"))


def tok(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({x}, ''), '[\x20\x09-\x0D]+'), lambda tk: tk <> '')"


def head(x: str, n: int = 8) -> str:
    return f"array_to_string({tok(x)}[1:{n}], ' ')"


FOLD = f"'{text.FOLD_FROM}', '{text.FOLD_TO}'"
NORMAL = f"translate(lower(coalesce(text, '')), '{text.ACCENT_FROM}{text.FOLD_FROM}{text.MARKS}', '{text.ACCENT_TO}{text.FOLD_TO}')"
SQUEEZE = r"trim(regexp_replace({}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"


# Text


@registered(f"SELECT doc_id, {SQUEEZE.format('translate(lower(nfc_normalize(coalesce(text, %s))), %s, %s)')} AS normal FROM documents" % ("''", f"'{text.ACCENT_FROM}{text.FOLD_FROM}{text.MARKS}'", f"'{text.ACCENT_TO}{text.FOLD_TO}'"))
def text_normalize(spark, sf_dir):
    return text.in_nfc(docs_of(spark, sf_dir), "text").select("doc_id", text.normal_form(F.col("text")).alias("normal"))


@registered(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '', 'g'), '[।॥]+', ' ', 'g'), '<[^>]+>', '', 'g'), '&[a-zA-Z]+;', '', 'g'), ' ') AS clean FROM documents")
def text_clean(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.cleaned(F.col("text")).alias("clean"))


@registered(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '', 'g'), '[।॥]+', ' ', 'g'), '<[^>]+>', '', 'g'), '&[a-zA-Z]+;', '', 'g'), ' ') AS clean FROM pages")
def page_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.cleaned(F.col("html")).alias("clean"))


@registered(r"SELECT doc_id, q AS cleaned, lower(q) AS ascii, len(" + tok("q") + r") AS words FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[।॥]+', ' ', 'g'), '[0-9]+', '', 'g'), '[/\[\](){}]+', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS q FROM documents)")
def query_preprocess(spark, sf_dir):
    q = docs_of(spark, sf_dir).select("doc_id", text.query_form(F.col("text")).alias("cleaned"))
    return q.select("doc_id", "cleaned", F.lower("cleaned").alias("ascii"), F.size(text.tokens(F.col("cleaned"))).cast("long").alias("words"))


@registered(rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(t, '[\x{{0900}}-\x{{097F}}]')) > length(t) * 0.1 THEN 'devanagari' WHEN len(regexp_extract_all(t, '[{text.FOLD_FROM}]')) > 2 THEN 'iast'
    WHEN len(regexp_extract_all(t, '[AEIOURLM~H]')) > length(t) * 0.1 AND t = upper(t) AND t <> lower(t) THEN 'hk' WHEN regexp_matches(t, '[~^]') THEN 'itrans' WHEN regexp_matches(lower(t), '[xyz]') THEN 'slp1' ELSE 'unknown' END AS script
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def script_detect(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.script(F.col("text")).alias("script"))


@registered(rf"SELECT doc_id, lower(regexp_replace(translate(coalesce(text, ''), {FOLD}), '[^\x00-\x7F]', '', 'g')) AS ascii FROM documents")
def ascii_fold(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.ascii_form(F.col("text")).alias("ascii"))


TEST_PREFIXES, TEST_SUFFIXES = ["the", "er", "ent", "ver"], ["tion", "ing", "ble"]


def compound_sql() -> str:
    w = "x"
    parts = f"CASE WHEN length({w}) < 6 THEN [{w}] "
    for p in TEST_PREFIXES:
        parts += f"WHEN starts_with({w}, '{p}') AND length({w}) > {len(p) + 2} THEN ['{p}', substr({w}, {len(p) + 1})] "
    for s in TEST_SUFFIXES:
        parts += f"WHEN ends_with({w}, '{s}') AND length({w}) > {len(s) + 2} THEN [left({w}, length({w}) - {len(s)}), '{s}'] "
    return f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, array_to_string(p, ' ') AS parts FROM (SELECT doc_id, flatten(list_transform({tok('text')}, lambda x: {parts} ELSE [x] END)) AS p FROM documents)"


@registered(compound_sql())
def compound_split(spark, sf_dir):
    p = docs_of(spark, sf_dir).select("doc_id", text.split_compounds(F.col("text"), TEST_PREFIXES, TEST_SUFFIXES).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.array_join("p", " ").alias("parts"))


@registered(f"""SELECT w, CASE WHEN ends_with(w, 'tion') THEN left(w, length(w) - 4) WHEN ends_with(w, 'ing') THEN left(w, length(w) - 3) ELSE w END AS lemma, 'unknown' AS pos, count(*) AS n
    FROM (SELECT unnest({tok('text')}) AS w FROM documents) GROUP BY w""")
def lemmas(spark, sf_dir):
    w = docs_of(spark, sf_dir).select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.select("w", text.lemma(F.col("w"), ["tion", "ing"]).alias("lemma"), text.part_of_speech(F.col("w")).alias("pos"), "n")


@registered(f"""SELECT DISTINCT item_id, unnest(list_concat(list_concat([low, translate(low, {FOLD})], CASE WHEN contains(low, 'the') THEN ['the', 'that', 'this'] ELSE [] END), CASE WHEN contains(low, 'der') THEN ['der', 'die'] ELSE [] END)) AS variant
    FROM (SELECT item_id, lower(coalesce(text, '')) AS low FROM benchmark)""")
def term_variants(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.variants(F.col("text"), {"the": ["the", "that", "this"], "der": ["der", "die"]})).alias("variant"))


def telling_sql(t: str) -> str:
    words = " + ".join(rf"CAST(regexp_matches(lower({t}), '{w}($|[^\p{{L}}\p{{N}}_])') AS INT)" for w in text.TELLING)
    return rf"(len(regexp_extract_all({t}, '[\x{{0900}}-\x{{097F}}]')) > length({t}) * 0.1 OR len(regexp_extract_all(lower({t}), '[{text.FOLD_FROM}]')) > 3 OR {words} > 1)"


@registered(f"SELECT doc_id, {telling_sql('t')} AS telling FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def lang_heuristic(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.is_telling(F.col("text")).alias("telling"))


@registered(r"""SELECT doc_id, nullif(regexp_extract(t, '//([^/]+)//', 1), '') AS citation, nullif(regexp_extract(nullif(regexp_extract(t, '//([^/]+)//', 1), ''), '([A-Za-z]+P?)_?(\d+)?', 1), '') AS abbreviation,
    nullif(regexp_extract(t, '(\d+)\.(\d+)', 1), '') AS chapter, nullif(regexp_extract(t, '(\d+)\.(\d+)', 2), '') AS verse FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def citation_extract(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in text.citation(F.col("text")).items()])


@registered(f"SELECT doc_id, CAST(length(t) // 50 * 50 AS BIGINT) AS chars_50, CAST(len({tok('t')}) // 5 * 5 AS BIGINT) AS words_5, CAST(length(t) // 100 * 100 AS BIGINT) AS chars_100 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def length_buckets(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in text.length_buckets(F.col("text")).items()])


def metadata_sql() -> str:
    own = "(cat <> '' AND cat <> '1_sanskr')"
    named = "CASE WHEN cat = '' OR cat = '1_sanskr' THEN 'Sanskrit Text' " + " ".join(f"WHEN lower(cat) = '{k}' THEN '{v}'" for k, v in metadata.CATEGORIES.items()) + " ELSE upper(left(cat, 1)) || lower(substr(cat, 2)) END"

    def column(i: int) -> str:
        value = lambda r: f"CASE WHEN {own} THEN {named} ELSE '{r[3]}' END" if i == 3 else f"'{r[i]}'"
        out = "CASE WHEN name = '' THEN " + ("CASE WHEN cat <> '' THEN cat ELSE 'Unknown' END" if i == 3 else "'Unknown'")
        out += "".join(f" WHEN contains(short, '{r[0]}') THEN {value(r)}" for r in [*metadata.WORKS, *metadata.PATTERNS])
        out += "".join(f" WHEN contains(name, '{r[0]}') THEN '{r[i]}'" for r in metadata.CITATIONS)
        rest = {1: "CASE " + " ".join(f"WHEN contains(short, '{p}') THEN '{w}'" for p, w in metadata.HINTS) + " ELSE 'Sanskrit Text' END", 2: "'Unknown'", 3: f"CASE WHEN cat <> '' THEN {named} ELSE 'Sanskrit Text' END"}[i]
        return out + f" ELSE {rest} END"

    return f"""SELECT page_id, {column(1)} AS work, {column(2)} AS author, {column(3)} AS category
        FROM (SELECT page_id, name, cat, regexp_replace(replace(lower(name), '.htm', ''), '\\.html|[0-9\\-_]', '', 'g') AS short
              FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS name, regexp_extract(url, '/([a-z][a-z])/', 1) AS cat FROM pages))"""


@registered(metadata_sql())
def metadata_map(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("name"), F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("cat"))
    return p.select("page_id", metadata.work_of(F.col("name"), F.col("cat")).alias("m")).select("page_id", "m.work", "m.author", "m.category")


@registered("SELECT DISTINCT lang, upper(left(lang, 1)) || substr(lang, 2) AS name FROM documents")
def category_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang").distinct().select("lang", metadata.category_name(F.col("lang")).alias("name"))


@registered("SELECT page_id, coalesce(list_filter(string_split(path, '/'), lambda p: regexp_matches(p, '^[1-7]_'))[1], 'unknown') AS category FROM (SELECT page_id, 'corpus/' || (page_id % 9) || '_part/' || url AS path FROM pages)")
def path_category(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("corpus/"), (F.col("page_id") % 9).cast("string"), F.lit("_part/"), "url").alias("path"))
    return p.select("page_id", tables.category_of_path(F.col("path")).alias("category"))


@registered()
def transliterated(spark, sf_dir):
    t = docs_of(spark, sf_dir).select("doc_id", text.cleaned(F.col("text")).alias("t"))
    return t.select("doc_id", text.iast(F.col("t"), text.script(F.col("t"))).alias("iast"))


@registered()
def noisy_texts(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", datasets.noisy(F.col("text"), F.col("doc_id")).alias("noisy"))


# Sources


@registered("SELECT count(*) AS n_docs, count(DISTINCT source) AS n_works, count(DISTINCT lang) AS n_categories, round(avg(length(text)), 6) AS mean_length FROM documents")
def corpus_stats(spark, sf_dir):
    return Engine(spark, table(spark, sf_dir, "documents")).stats()


@registered("SELECT count(*) AS n_docs, md5(concat_ws('_', CAST(count(*) AS VARCHAR), arg_min(text, doc_id), arg_max(text, doc_id))) AS fingerprint FROM documents")
def corpus_fingerprint(spark, sf_dir):
    return tables.fingerprint(table(spark, sf_dir, "documents"))


@registered("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark, sf_dir):
    return tables.value_counts(table(spark, sf_dir, "documents"), "source")


PAGE_TEXT = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|section|article|nav|header|footer|title|head|body)[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g')"


@registered(rf"""WITH l AS (SELECT page_id, list_filter(list_transform(string_split({PAGE_TEXT}, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: length(x) >= 10 AND NOT regexp_matches(x, '^\d+$')) AS ls FROM pages),
    p AS (SELECT page_id, ls, unnest(range(len(ls) // 2)) AS position FROM l),
    t AS (SELECT page_id, CAST(position AS INT) AS position, ls[2 * position + 1] || ' ' || ls[2 * position + 2] AS text FROM p)
    SELECT page_id, position, text, CAST(length(text) AS INT) AS length FROM t WHERE {telling_sql('text')}""")
def html_passages(spark, sf_dir):
    return tables.html_passages(table(spark, sf_dir, "pages"), block_breaks=True)


@registered()
def tei_passages(spark, sf_dir):
    files = docs_of(spark, sf_dir).select(F.concat(F.lit("tei/"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"), F.concat(F.lit("<TEI><body><p>"), F.regexp_replace("text", "[<>&]", " "), F.lit("</p></body></TEI>")).alias("content"))
    return tables.tei_passages(files)


@registered(r"SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 10")
def valid_documents(spark, sf_dir):
    return search.valid(table(spark, sf_dir, "documents")).select("doc_id", F.length("text").cast("long").alias("n"))


@registered("""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents WHERE length(text) BETWEEN 50 AND 500)
    WHERE r <= floor(40 / (SELECT count(DISTINCT lang) FROM documents WHERE length(text) BETWEEN 50 AND 500))""")
def quote_sample(spark, sf_dir):
    return datasets.sample_quotes(table(spark, sf_dir, "documents"), 40).select("doc_id", "lang")


# Indexes


@registered(f"""WITH t AS (SELECT unnest(list_distinct({tok('text')})) AS term FROM documents), s AS (SELECT count(*) AS n FROM documents)
    SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t, s GROUP BY term""")
def bm25_term_stats(spark, sf_dir):
    return search.term_stats(corpus_of(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


GRAMS = "list_distinct(list_transform(range(1, greatest(0, length({0}) - 2) + 1), lambda i: substr({0}, i, 3)))"
CHARS = "string_split(replace(lower(coalesce({0}, '')), ' ', ''), '')"


def gram_list(x: str) -> str:
    return f"list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))".replace("c[", f"{x}[").replace("len(c)", f"len({x})")


@registered(f"""WITH c AS (SELECT doc_id, {CHARS.format('text')} AS c FROM documents), g AS (SELECT doc_id, {gram_list('c')} AS g FROM c WHERE len(c) >= 3)
    SELECT gram, count(*) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, unnest(g) AS gram FROM g) GROUP BY gram""")
def ngram_index(spark, sf_dir):
    return search.gram_index(corpus_of(spark, sf_dir)).groupBy("gram").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("ids"))


@registered(f"""WITH w AS (SELECT doc_id, {tok('lower(text)')} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 5)) AS s FROM w)
    SELECT doc_id, CAST(s AS INT) AS "start", CAST(least(s + 10, len(w)) AS INT) AS "end", array_to_string(w[s + 1:s + 10], ' ') AS words FROM s""")
def window_index(spark, sf_dir):
    return search.window_index(corpus_of(spark, sf_dir)).withColumn("words", F.array_join("words", " "))


@registered(f"""WITH w AS (SELECT doc_id, {tok('lower(text)')} AS w FROM documents), n AS (SELECT doc_id, w, unnest(range(3, 21)) AS n FROM w WHERE len(w) >= 3), s AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM n WHERE n <= len(w))
    SELECT array_to_string(w[s + 1:s + n], ' ') AS gram, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY 1""")
def word_ngrams(spark, sf_dir):
    return search.word_ngrams(corpus_of(spark, sf_dir)).groupBy("gram").agg(F.countDistinct("doc_id").alias("n_docs"))


# Retrieval

BM25_CTE = f"""d AS (SELECT doc_id, {tok('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
    tf AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) GROUP BY doc_id, w, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tok('query')}) AS term FROM qs) GROUP BY query_id, term),
    bm AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id)"""


def ranked_sql(source: str, k: int, order: str = "score DESC, doc_id") -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INT) AS rank FROM {source}) WHERE rank <= {k}"


QUOTES = "qs AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"


@registered(f"WITH {QUOTES}, {BM25_CTE}, r AS ({ranked_sql('bm', 10)}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r")
def bm25_topk(spark, sf_dir):
    return search.bm25(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


GRAM_CTE = f"""dc AS (SELECT doc_id, {CHARS.format('text')} AS c FROM documents), dg AS (SELECT doc_id, {gram_list('c')} AS g FROM dc WHERE len(c) >= 3), di AS (SELECT doc_id, len(g) AS nd, unnest(g) AS gram FROM dg),
    qc AS (SELECT query_id, {CHARS.format('query')} AS c FROM qs), qg AS (SELECT query_id, {gram_list('c')} AS g FROM qc WHERE len(c) >= 3), qi AS (SELECT query_id, len(g) AS nq, unnest(g) AS gram FROM qg),
    gr AS (SELECT query_id, doc_id, count(*) / (any_value(nq) + any_value(nd) - count(*)) AS score FROM di JOIN qi USING (gram) GROUP BY query_id, doc_id)"""


@registered(f"WITH {QUOTES}, {GRAM_CTE}, r AS ({ranked_sql('gr', 10)}) SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r")
def ngram_jaccard_topk(spark, sf_dir):
    return search.gram_search(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


# Every pair of neighbouring windows is tried here; the query needs only the last that can hold an offset.  A quote longer than two windows counts wherever it fits.
PARTIAL_CTE = f"""pw AS (SELECT doc_id, {tok('lower(text)')} AS w FROM documents), pd AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM pw),
    pqw AS (SELECT query_id, {tok('lower(query)')} AS qw FROM qs), pq AS (SELECT query_id, len(qw) AS qlen, unnest(qw) AS word, generate_subscripts(qw, 1) - 1 AS qpos FROM pqw),
    po AS (SELECT query_id, doc_id, qlen, n, pos - qpos AS place, count(*) AS hits FROM pd JOIN pq USING (word) GROUP BY ALL),
    pc AS (SELECT * FROM po WHERE n > 5 AND place >= 0 AND place + qlen <= n AND (qlen > 15 OR len(list_filter(range(0, (n - 1) // 5), lambda i: i * 5 <= place AND place + qlen <= least((i + 1) * 5 + 10, n))) > 0)),
    pn AS (SELECT query_id, count(DISTINCT word) AS needs, max(CASE WHEN qpos = 0 THEN 1 ELSE 0 END) AS hf FROM pq WHERE word IN (SELECT word FROM pd) GROUP BY query_id),
    ph AS (SELECT query_id, doc_id, count(DISTINCT word) AS has FROM pd JOIN pq USING (word) WHERE n <= 5 GROUP BY query_id, doc_id),
    pf AS (SELECT po.* FROM po JOIN ph USING (query_id, doc_id) JOIN pn USING (query_id) WHERE n <= 5 AND place >= 0 AND place + qlen <= n AND has = needs AND hf = 1),
    pa AS (SELECT query_id, doc_id, hits / qlen AS score, place FROM pc UNION ALL SELECT query_id, doc_id, hits / qlen, place FROM pf),
    pr AS (SELECT query_id, doc_id, max(score) AS score, arg_min(place, (-score, place)) AS place FROM pa GROUP BY query_id, doc_id)"""


@registered(f'''WITH {QUOTES}, {PARTIAL_CTE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(place AS INT) AS "at" FROM pr WHERE score > 0''')
def partial_match(spark, sf_dir):
    return search.partial_search(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), wide=True).filter("score > 0").withColumn("score", F.round("score", 6))


@registered(f"""WITH {QUOTES}, {PARTIAL_CTE}, h AS ({ranked_sql('pr', 3)}), o AS (SELECT doc_id, {tok('text')} AS w FROM documents)
    SELECT query_id, doc_id, CAST(place AS INT) AS "at", array_to_string(w[greatest(0, place - 5) + 1:least(len(w), place + 5)], ' ') AS context FROM h JOIN o USING (doc_id)""")
def match_context(spark, sf_dir):
    docs, quotes = corpus_of(spark, sf_dir), quotes_of(spark, sf_dir)
    return search.match_context(docs, scans.few(search.top(search.partial_search(docs, quotes, wide=True, k=3), 3), quotes))


@registered("""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6) AS score
    FROM embeddings v, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS INT) AS rank FROM p) WHERE rank <= 10""")
def dense_cosine_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.cosine_search(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


TEST_SYNONYMS = {"the ": ["of ", "and "], "der ": ["die "], "que ": ["la "]}
VARIANTS_SQL = "SELECT DISTINCT query_id, unnest(list_concat([query], " + "list_concat(".join(f"CASE WHEN contains(lower(query), '{k}') THEN [{', '.join(f"replace(lower(query), '{k}', '{s}')" for s in ss)}] ELSE [] END, " for k, ss in TEST_SYNONYMS.items()) + "[]" + ")" * len(TEST_SYNONYMS) + ") AS variant FROM qs"


@registered(f"WITH {QUOTES} {VARIANTS_SQL}")
def synonym_expand(spark, sf_dir):
    return search.expand_synonyms(quotes_of(spark, sf_dir), TEST_SYNONYMS)


def fused_sql(k: int) -> str:
    inner_bm = BM25_CTE.replace("FROM qs", "FROM vs").replace("SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest", "SELECT variant_id AS query_id, term, count(*) AS times FROM (SELECT variant_id, unnest").replace("GROUP BY query_id, term)", "GROUP BY variant_id, term)").replace(tok("query"), tok("variant"))
    inner_gr = GRAM_CTE.replace("FROM qs", "FROM vs").replace(f"SELECT query_id, {CHARS.format('query')} AS c", f"SELECT variant_id AS query_id, {CHARS.format('variant')} AS c")
    return f"""{QUOTES}, vs0 AS ({VARIANTS_SQL}), vs AS (SELECT query_id AS q0, variant, query_id || '|' || variant AS variant_id, count(*) OVER (PARTITION BY query_id) AS nv FROM vs0), {inner_bm}, {inner_gr}, {PARTIAL_CTE},
    lists AS (SELECT 0.6 AS weight, * FROM ({ranked_sql('bm', 2 * k)}) UNION ALL SELECT 0.4, * FROM ({ranked_sql('gr', 2 * k)})),
    normed AS (SELECT query_id AS variant_id, doc_id, weight * score / CASE WHEN max(score) OVER (PARTITION BY weight, query_id) = 0 THEN 1 ELSE max(score) OVER (PARTITION BY weight, query_id) END AS part FROM lists),
    base AS (SELECT q0 AS query_id, doc_id, sum(part / nv) AS base FROM normed JOIN vs USING (variant_id) GROUP BY q0, doc_id),
    merged AS (SELECT query_id, doc_id, round(CASE WHEN score IS NULL THEN base WHEN base IS NULL THEN score * 0.8 ELSE base * 0.7 + score * 0.5 END, 6) AS score, round(base, 6) AS base, round(score, 6) AS partial
        FROM base FULL JOIN (SELECT query_id, doc_id, score FROM pr WHERE score > 0) USING (query_id, doc_id)),
    fused AS ({ranked_sql('merged', k)})"""


@registered(f"WITH {fused_sql(10)} SELECT query_id, doc_id, score, base, partial, rank FROM fused")
def fused_search(spark, sf_dir):
    return search.fused_search(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 10, TEST_SYNONYMS, wide=True)


@registered(f"""WITH {QUOTES}, d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, {tok('lower(text)')} AS w FROM documents), q AS (SELECT query_id, {tok('lower(query)')} AS ts FROM qs),
    p AS (SELECT query_id, doc_id, len(w) AS n, list_transform(ts, lambda t: CASE WHEN list_contains(w, t) THEN 2.0 WHEN contains(low, t) THEN 1.0 ELSE 0.0 END) AS pts FROM d, q),
    s AS (SELECT query_id, doc_id, round(list_sum(pts)::DOUBLE * CASE WHEN len(pts) > 1 AND len(list_filter(pts, lambda x: x > 0)) > 1 THEN 1 + 0.2 * len(list_filter(pts, lambda x: x > 0)) ELSE 1 END / (1 + n / 100), 6) AS score FROM p WHERE len(pts) > 0)
    SELECT query_id, doc_id, score, rank FROM ({ranked_sql('(SELECT * FROM s WHERE score > 0)', 10)})""")
def simple_search(spark, sf_dir):
    return search.simple_search(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 10)


OVERLAP_CTE = f"""od AS (SELECT doc_id, unnest(list_distinct({tok('lower(text)')})) AS word FROM documents), oq0 AS (SELECT query_id, list_distinct({tok('lower(query)')}) AS w FROM qs), oq AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM oq0),
    ov AS (SELECT query_id, doc_id, count(*) / any_value(n) AS score FROM od JOIN oq USING (word) GROUP BY query_id, doc_id)"""


@registered(f"WITH {QUOTES}, {OVERLAP_CTE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({ranked_sql('ov', 10)})")
def overlap_search(spark, sf_dir):
    return search.top(search.overlap_scores(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir)), 10).withColumn("score", F.round("score", 6))


STAGES_SQL = f"""{QUOTES}, {OVERLAP_CTE}, s1 AS ({ranked_sql('ov', 10)}),
    s2 AS (SELECT query_id, s1.doc_id AS doc_id, round(s1.score, 6) AS s1, round(s1.score + 0.5 * CAST(contains(lower(text), lower(query)) AS INT) + 0.3 * least(length(query), length(text)) / greatest(length(query), length(text)), 6) AS s2
        FROM s1 JOIN documents d ON d.doc_id = s1.doc_id JOIN qs USING (query_id)), s3 AS ({ranked_sql('s2', 3, 's2 DESC, doc_id')})"""


@registered(f'WITH {STAGES_SQL} SELECT query_id, doc_id, s1, s2, rank, s2 > 0.7 AS "match", least(s2, 1.0) AS confidence FROM s3')
def demo_three_stage(spark, sf_dir):
    return search.three_stages(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir))


@registered(f"""WITH {QUOTES}, {BM25_CTE}, h AS (SELECT query_id, doc_id, round(score, 6) AS score, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 0.5::DOUBLE END AS llm_score FROM ({ranked_sql('bm', 20)}))
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY llm_score IS NULL, llm_score DESC, score DESC, doc_id) AS INT) AS rank FROM h""")
def llm_first_order(spark, sf_dir):
    hits = search.bm25(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 + F.lit(0.5)).alias("llm_score"))
    return search.llm_first(hits)


# Entities and graph.  The lexicon and the relations are made by rule from the corpus, as the default ones do not occur in it.


def graph_of(spark, sf_dir):
    # Eighty rows at most, by the rule that makes them; kept, as every part of a query meets them.
    names = graph.lexicon_of_corpus(docs_of(spark, sf_dir)).persist()
    edges = graph.with_inverse(graph.relations_of_lexicon(names))
    works = names.select(F.col("canonical").alias("entity"), F.concat(F.lit("w"), (F.col("canon_ord") % 3).cast("string")).alias("work")).distinct()
    return names, edges, works


def titles_made(works):
    return works.select("work").distinct().select("work", F.concat(F.lit("title of "), "work").alias("title"), F.lit("someone").alias("author"))


def values_sql(rows: list[str], chosen: str) -> str:
    return f"list_extract([{', '.join(f"'{r}'" for r in rows)}], CAST({chosen} AS BIGINT))"


LEXICON_CTE = f"""lw AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct({tok('lower(text)')})) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{{5,}}') GROUP BY w),
    lr AS (SELECT w, row_number() OVER (ORDER BY df DESC, w) - 1 AS r FROM lw ORDER BY df DESC, w LIMIT 80),
    ln AS (SELECT {values_sql(graph.ETYPES, '(r // 2) % 5 + 1')} AS etype, CAST(r // 2 // 5 AS INT) AS canon_ord, w AS variant, r % 2 AS k FROM lr),
    lex AS (SELECT etype, canon_ord, b.variant AS canonical, a.variant AS variant FROM ln a JOIN (SELECT etype, canon_ord, variant FROM ln WHERE k = 0) b USING (etype, canon_ord)),
    lk AS (SELECT canonical, row_number() OVER (ORDER BY etype, canon_ord) - 1 AS k FROM (SELECT DISTINCT etype, canon_ord, canonical FROM lex)),
    le AS (SELECT CAST(a.k * 10 + s AS INT) AS edge_ord, a.canonical AS src, {values_sql(list(graph.INVERSE), '(a.k + s) % 10 + 1')} AS rel, b.canonical AS dst FROM lk a, (SELECT unnest([1, 3]) AS s) t, lk b WHERE b.k = a.k + s AND (a.k + s) % 4 <> 0),
    edges AS (SELECT src, rel, dst, min(edge_ord) AS edge_ord FROM (SELECT src, rel, dst, edge_ord FROM le UNION ALL SELECT dst, {values_sql(list(graph.INVERSE.values()), f"list_position([{', '.join(f"'{r}'" for r in graph.INVERSE)}], rel)")}, src, edge_ord FROM le) GROUP BY src, rel, dst),
    works AS (SELECT DISTINCT canonical AS entity, 'w' || (canon_ord % 3) AS work FROM lex),
    lv AS (SELECT etype, variant, arg_min(canonical, canon_ord) AS canonical FROM lex GROUP BY etype, variant)"""


def mention_sql(name: str, source: str, key: str, column: str) -> str:
    return rf"""{name}w AS (SELECT {key}, regexp_extract_all(coalesce({column}, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ws FROM {source}), {name}e AS (SELECT {key}, unnest(ws) AS piece, generate_subscripts(ws, 1) - 1 AS k, regexp_matches(ws[1], '^[\p{{L}}\p{{N}}_]') AS lead FROM {name}w),
    {name}p AS (SELECT {key}, lower(piece) AS matched, (k - CASE WHEN lead THEN 0 ELSE 1 END) // 2 AS place, coalesce(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts FROM {name}e),
    {name} AS (SELECT {key}, etype, canonical, matched, place, starts FROM {name}p JOIN lv ON matched = variant)"""


@registered(f"""WITH {LEXICON_CTE}, {mention_sql('m', 'documents', 'doc_id', 'text')} SELECT doc_id, etype, canonical, matched, CAST(place AS INT) AS "at", CAST(starts AS INT) AS "start", CAST(starts + length(matched) AS INT) AS "end" FROM m""")
def entity_mentions(spark, sf_dir):
    names, _, _ = graph_of(spark, sf_dir)
    docs = docs_of(spark, sf_dir)
    return graph.with_offsets(graph.mentions(docs, names, most_words=1), docs)


@registered(f"""WITH {LEXICON_CTE}, {mention_sql('m', 'documents', 'doc_id', 'text')}, c AS (SELECT doc_id, {', '.join(f"count(*) FILTER (etype = '{t}') AS {t}_count" for t in graph.ETYPES)}, count(*) AS total, {', '.join(f"count(DISTINCT canonical) FILTER (etype = '{t}') AS unique_{t}" for t in graph.ETYPES)} FROM m GROUP BY doc_id),
    s AS (SELECT doc_id, len({tok('text')}) AS words FROM documents), j AS (SELECT s.doc_id, words, {', '.join(f"coalesce({c}, 0) AS {c}" for c in [*[f"{t}_count" for t in graph.ETYPES], "total", *[f"unique_{t}" for t in graph.ETYPES]])} FROM s LEFT JOIN c USING (doc_id))
    SELECT * EXCLUDE (words), {', '.join(f"round(CASE WHEN words > 0 THEN {c} / words ELSE 0 END, 9)::DOUBLE AS {d}_density" for c, d in (('total', 'entity'), ('deities_count', 'deity'), ('concepts_count', 'concept')))} FROM j""")
def entity_features(spark, sf_dir):
    names, _, _ = graph_of(spark, sf_dir)
    return graph.entity_features(docs_of(spark, sf_dir), names)


@registered(f"WITH {LEXICON_CTE} SELECT src AS entity, rel, dst AS neighbour, CAST(row_number() OVER (PARTITION BY src ORDER BY edge_ord, dst, rel) AS INT) AS ord FROM edges")
def kg_neighbors(spark, sf_dir):
    names, edges, _ = graph_of(spark, sf_dir)
    return graph.neighbours(edges, names.select(F.col("canonical").alias("entity")).distinct())


PATH_CTE = """st AS (SELECT DISTINCT src, dst FROM edges), nd AS (SELECT src AS x FROM st UNION SELECT dst FROM st),
    p0 AS (SELECT x AS a, x AS b, 0 AS hops FROM nd), p1 AS (SELECT DISTINCT a, dst AS b, 1 AS hops FROM p0 JOIN st ON b = src), p2 AS (SELECT DISTINCT a, dst AS b, 2 AS hops FROM p1 JOIN st ON b = src), p3 AS (SELECT DISTINCT a, dst AS b, 3 AS hops FROM p2 JOIN st ON b = src),
    ways AS (SELECT a, b, min(hops) AS hops FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY a, b)"""


@registered(f"WITH {LEXICON_CTE}, {PATH_CTE} SELECT * FROM ways")
def kg_paths(spark, sf_dir):
    return graph.paths(graph_of(spark, sf_dir)[1])


CONCEPT_ROWS = ", ".join(f"('{p}', '{c}')" for p, cs in {**graph.CONCEPTS, "jñānayoga": ["puruṣārtha"]}.items() for c in cs)


@registered(f"WITH RECURSIVE pairs(parent, child) AS (VALUES {CONCEPT_ROWS}), below AS (SELECT parent AS ancestor, child AS concept, 1 AS depth FROM pairs UNION ALL SELECT ancestor, p.child, depth + 1 FROM below JOIN pairs p ON p.parent = below.concept WHERE depth < 20) SELECT ancestor, concept, min(depth) AS depth FROM below GROUP BY ancestor, concept")
def kg_descendants(spark, sf_dir):
    return graph.descendants(spark, spark.sql(f"SELECT * FROM VALUES {CONCEPT_ROWS} AS t(parent, child)"))


@registered(f"""WITH {LEXICON_CTE}, {mention_sql('m', 'documents', 'doc_id', 'text')}, w AS (SELECT DISTINCT doc_id AS group_id, canonical AS entity FROM m), n AS (SELECT group_id, count(*) AS need FROM w GROUP BY group_id)
    SELECT group_id, work FROM (SELECT group_id, work, count(*) AS has FROM w JOIN works USING (entity) GROUP BY group_id, work) JOIN n USING (group_id) WHERE has = need""")
def kg_common_works(spark, sf_dir):
    names, _, works = graph_of(spark, sf_dir)
    found = graph.mentions(docs_of(spark, sf_dir), names)
    return graph.common_works(works, found.select(F.col("doc_id").alias("group_id"), F.col("canonical").alias("entity")))


@registered(f"""WITH {LEXICON_CTE}, {QUOTES}, {mention_sql('m', 'qs', 'query_id', 'query')}, f AS (SELECT DISTINCT query_id, canonical AS entity, matched FROM m),
    nb AS (SELECT * FROM (SELECT src AS entity, rel, dst, row_number() OVER (PARTITION BY src ORDER BY edge_ord, dst, rel) AS ord FROM edges) WHERE ord <= 5),
    v AS (SELECT query_id, CASE WHEN rel IN ('avatar_of', 'has_avatar', 'also_known_as') THEN replace(lower(query), matched, dst) WHEN rel IN ('consort_of', 'devotee_of', 'student_of') THEN lower(query) || ' ' || dst END AS variant FROM f JOIN nb USING (entity) JOIN qs USING (query_id)),
    t AS (SELECT DISTINCT query_id, canonical AS entity FROM m WHERE etype IN ('deities', 'sages')), tn AS (SELECT query_id, count(*) AS need FROM t GROUP BY query_id),
    tw AS (SELECT query_id, work, row_number() OVER (PARTITION BY query_id ORDER BY work) AS k FROM (SELECT query_id, work, count(*) AS has FROM t JOIN works USING (entity) GROUP BY query_id, work) JOIN tn USING (query_id) WHERE has = need)
    SELECT DISTINCT query_id, variant FROM (SELECT query_id, query AS variant FROM qs UNION ALL SELECT * FROM v WHERE variant IS NOT NULL UNION ALL SELECT query_id, lower(query) || ' title of ' || work FROM tw JOIN qs USING (query_id) WHERE k <= 5)""")
def kg_query_expand(spark, sf_dir):
    names, edges, works = graph_of(spark, sf_dir)
    return graph.expand_by_graph(quotes_of(spark, sf_dir), names, edges, works, titles_made(works))


@registered(f"""WITH {LEXICON_CTE}, e AS (SELECT DISTINCT canonical AS entity FROM lex), r AS (SELECT src AS entity, string_agg(ord || ' ' || rel || ' ' || dst, '; ' ORDER BY ord) AS relations FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_ord, dst, rel) AS ord FROM edges) GROUP BY src),
    w AS (SELECT entity, string_agg(work, '; ' ORDER BY work) AS works, string_agg(work || ' title of ' || work || ' someone', '; ' ORDER BY work) AS work_details FROM works GROUP BY entity)
    SELECT entity, coalesce(relations, '') AS relations, coalesce(works, '') AS works, coalesce(work_details, '') AS work_details, '' AS related_concepts FROM e LEFT JOIN r USING (entity) LEFT JOIN w USING (entity)""")
def kg_context(spark, sf_dir):
    names, edges, works = graph_of(spark, sf_dir)
    found = graph.entity_context(names.select(F.col("canonical").alias("entity")), edges, works, titles_made(works), graph.concepts_of(spark))
    line = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[p].cast("string") for p in parts])), "; ").alias(c)
    return found.select("entity", line("relations", "ord", "rel", "neighbour"), F.array_join("works", "; ").alias("works"), line("work_details", "work", "title", "author"), F.array_join("related_concepts", "; ").alias("related_concepts"))


def pair_hits(spark, sf_dir):
    """The five best hits of each quote by BM25: what pair features are computed on."""
    return search.bm25(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 5).withColumn("score", F.round("score", 6))


HITS_CTE = f"{QUOTES}, {BM25_CTE}, hits AS (SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ({ranked_sql('bm', 5)}))"


def kg_sql() -> str:
    sets = "".join(f", coalesce(list_sort(list_distinct(list(canonical) FILTER (etype = '{t}'))), []) AS {t}" for t in graph.ETYPES)
    out = []
    for t in graph.ETYPES:
        out.append(f"len(list_intersect(q.{t}, d.{t}))::DOUBLE AS {t}_overlap, round(CASE WHEN len(list_distinct(q.{t} || d.{t})) > 0 THEN len(list_intersect(q.{t}, d.{t})) / len(list_distinct(q.{t} || d.{t})) ELSE 0 END, 9) AS {t}_jaccard")
    rel = "len(list_filter(q.near, lambda e: list_contains(d.every, e)))"
    out.append(f"{rel}::DOUBLE AS related_entity_overlap, round({rel} / greatest(len(q.near), 1), 9) AS related_entity_ratio")
    both = "len(list_intersect(q.allworks, d.allworks))"
    out.append(f"{both}::DOUBLE AS common_works, round({both} / greatest(len(list_distinct(q.allworks || d.allworks)), 1), 9) AS work_overlap_ratio")
    out.append("coalesce(cw.n, 0)::DOUBLE AS entity_cooccurrence_works, coalesce(wy.least, 10)::DOUBLE AS min_path_length, round(coalesce(wy.mean, 10), 9)::DOUBLE AS avg_path_length, coalesce(wy.connected, 0)::DOUBLE AS connected_pairs")

    def side(name: str, m: str, key: str, source: str) -> str:
        return f"""{name}0 AS (SELECT {key}{sets}, list_sort(list_distinct(list(canonical))) AS every FROM {m} GROUP BY {key}),
            {name}1 AS (SELECT s.{key}{''.join(f', coalesce({t}, []) AS {t}' for t in graph.ETYPES)}, coalesce(every, []) AS every FROM {source} s LEFT JOIN {name}0 USING ({key})),
            {name}n AS (SELECT {key}, list(dst) AS near FROM (SELECT {key}, unnest(every) AS e FROM {name}1) JOIN st ON e = src GROUP BY {key}),
            {name}k AS (SELECT {key}, list_distinct(list(work)) AS ws FROM (SELECT {key}, unnest(every) AS e FROM {name}1) JOIN works ON e = entity GROUP BY {key}),
            {name} AS (SELECT a.*, coalesce(near, []) AS near, list_distinct(coalesce(ws, []) || a.works) AS allworks FROM {name}1 a LEFT JOIN {name}n USING ({key}) LEFT JOIN {name}k USING ({key}))"""

    weights = " + ".join(f"{w} * {n}" for n, w in graph.KG_WEIGHTS.items())
    return f"""{LEXICON_CTE}, {PATH_CTE.replace('st AS', 'st AS', 1)}, {HITS_CTE.replace(', st AS (SELECT count(*) AS n, avg', ', bst AS (SELECT count(*) AS n, avg').replace('JOIN df USING (term), st GROUP', 'JOIN df USING (term), bst GROUP')},
        {mention_sql('qm', 'qs', 'query_id', 'query')}, {mention_sql('dm', '(SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM hits))', 'doc_id', 'text')},
        {side('qz', 'qm', 'query_id', 'qs')}, {side('dz', 'dm', 'doc_id', '(SELECT DISTINCT doc_id FROM hits)')},
        fp AS (SELECT query_id, doc_id, unnest(qz.every[1:5]) AS a, dz.every[1:5] AS ds FROM hits JOIN qz USING (query_id) JOIN dz USING (doc_id)), fq AS (SELECT query_id, doc_id, a, unnest(ds) AS b FROM fp),
        wy AS (SELECT query_id, doc_id, min(h) AS least, avg(h) AS mean, count(h) AS connected FROM (SELECT fq.*, coalesce(hops, CASE WHEN fq.a = fq.b THEN 0 END) AS h FROM fq LEFT JOIN ways USING (a, b)) GROUP BY query_id, doc_id),
        un AS (SELECT query_id, doc_id, unnest(list_distinct(qz.every || dz.every)) AS entity FROM hits JOIN qz USING (query_id) JOIN dz USING (doc_id) WHERE len(qz.every) > 0 AND len(dz.every) > 0),
        nn AS (SELECT query_id, doc_id, count(*) AS need FROM un GROUP BY query_id, doc_id), cw AS (SELECT query_id, doc_id, count(*) AS n FROM (SELECT query_id, doc_id, work, count(*) AS has FROM un JOIN works USING (entity) GROUP BY query_id, doc_id, work) JOIN nn USING (query_id, doc_id) WHERE has = need GROUP BY query_id, doc_id),
        kf AS (SELECT h.query_id, h.doc_id, h.score, {', '.join(out)} FROM hits h JOIN qz q ON q.query_id = h.query_id JOIN dz d ON d.doc_id = h.doc_id LEFT JOIN wy ON wy.query_id = h.query_id AND wy.doc_id = h.doc_id LEFT JOIN cw ON cw.query_id = h.query_id AND cw.doc_id = h.doc_id),
        ks AS (SELECT *, round(least(1.0, ({weights}) / 14.0), 9) AS kg_score FROM kf)"""


@registered(f"WITH {kg_sql()} SELECT * EXCLUDE (score) FROM ks")
def kg_features(spark, sf_dir):
    names, edges, works = graph_of(spark, sf_dir)
    return graph.pair_features(pair_hits(spark, sf_dir).persist(), quotes_of(spark, sf_dir), corpus_of(spark, sf_dir), names, edges, works).drop("q_every", "q_works")


@registered(f"WITH {kg_sql()}, r AS (SELECT query_id, doc_id, score, kg_score, round(0.7 * score + 0.3 * kg_score, 6) AS combined_score FROM ks) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, doc_id) AS INT) AS kg_rank FROM r")
def kg_rerank(spark, sf_dir):
    names, edges, works = graph_of(spark, sf_dir)
    hits = pair_hits(spark, sf_dir).drop("rank").persist()
    return graph.rerank(hits, graph.pair_features(hits, quotes_of(spark, sf_dir), corpus_of(spark, sf_dir), names, edges, works))


@registered(f"""WITH {kg_sql()}, s AS (SELECT query_id, doc_id, list_filter([CASE WHEN related_entity_ratio > 0 THEN related_entity_ratio END, CASE WHEN work_overlap_ratio > 0 THEN work_overlap_ratio END, CASE WHEN min_path_length < 10 THEN 1 / (1 + min_path_length) END], lambda x: x IS NOT NULL) AS l FROM ks)
    SELECT query_id, doc_id, consistency FROM (SELECT query_id, doc_id, round(CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) ELSE 0 END, 6) AS consistency FROM s) WHERE consistency >= 0.3""")
def kg_consistency(spark, sf_dir):
    names, edges, works = graph_of(spark, sf_dir)
    features = graph.pair_features(pair_hits(spark, sf_dir).persist(), quotes_of(spark, sf_dir), corpus_of(spark, sf_dir), names, edges, works)
    return graph.consistency(features).filter("consistency >= 0.3").select("query_id", "doc_id", "consistency")


# Features of pairs


def pairs_of(spark, sf_dir):
    quotes = quotes_of(spark, sf_dir)
    return scans.few(pair_hits(spark, sf_dir).select("query_id", "doc_id"), quotes).join(corpus_of(spark, sf_dir), "doc_id").join(quotes, "query_id")


PAIRS_CTE = f"{HITS_CTE}, pr AS (SELECT h.query_id, h.doc_id, query AS q, coalesce(text, '') AS p FROM hits h JOIN qs USING (query_id) JOIN documents d ON d.doc_id = h.doc_id)"


def featured(spark, sf_dir, make):
    p = pairs_of(spark, sf_dir)
    made = make(F.col("query"), F.col("text"))
    out = p.select("query_id", "doc_id", *[c.alias(k) for k, c in made.items()])
    return out.select("query_id", "doc_id", *[F.round(k, 9).alias(k) if t == "double" else F.col(k).cast("long" if t == "int" else t).alias(k) for k, t in out.dtypes[2:]])


QW, PW = tok("lower(q)"), tok("lower(p)")


def part_sql(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END, 9)::DOUBLE"


def raw_grams(x: str) -> str:
    return f"CASE WHEN length({x}) >= 3 THEN {gram_list(f'string_split({x}, {chr(39)}{chr(39)})')} ELSE [] END"


@registered(f"""WITH {PAIRS_CTE}, w AS (SELECT *, list_distinct({QW}) AS qs1, list_distinct({PW}) AS ps1, string_split(q, '') AS qc, string_split(p, '') AS pc FROM pr), g AS (SELECT *, CASE WHEN len(qc) >= 3 THEN {gram_list('qc')} ELSE [] END AS qg, CASE WHEN len(pc) >= 3 THEN {gram_list('pc')} ELSE [] END AS pg FROM w)
    SELECT query_id, doc_id, {part_sql('len(list_intersect(qs1, ps1))', 'len(qs1)')} AS word_overlap, {part_sql('len(list_intersect(qs1, ps1))', 'len(list_distinct(qs1 || ps1))')} AS jaccard, length(q) AS query_length, length(p) AS passage_length,
    round(length(q) / greatest(length(p), 1), 9) AS length_ratio, {part_sql('len(list_intersect(qg, pg))', 'len(qg)')} AS char_overlap FROM g""")
def lexical_features(spark, sf_dir):
    return featured(spark, sf_dir, pairs.basic_lexical)


@registered(f"""WITH {PAIRS_CTE}, w AS (SELECT *, {QW} AS qw, {PW} AS pw, list_distinct({QW}) AS a, list_distinct({PW}) AS b, list_filter(list_distinct(string_split(lower(q), '')), lambda c: c <> '') AS qc, list_distinct(string_split(lower(p), '')) AS pc FROM pr),
    v AS (SELECT *, list_filter(a, lambda x: length(x) <= 4) AS sa, list_filter(b, lambda x: length(x) <= 4) AS sb, list_filter(a, lambda x: length(x) > 4) AS la, list_filter(b, lambda x: length(x) > 4) AS lb FROM w)
    SELECT query_id, doc_id, {part_sql('len(list_intersect(a, b))', 'len(a)')} AS word_overlap_ratio, {part_sql('len(list_intersect(a, b))', 'len(list_distinct(a || b))')} AS jaccard_similarity, {part_sql('2 * len(list_intersect(a, b))', 'len(a) + len(b)')} AS dice_coefficient,
    {part_sql('len(list_intersect(sa, sb))', 'len(sa)')} AS short_word_overlap, {part_sql('len(list_intersect(la, lb))', 'len(la)')} AS long_word_overlap, length(q) AS query_length, length(p) AS passage_length, round(length(q) / greatest(length(p), 1), 9) AS length_ratio,
    abs(length(q) - length(p)) AS length_diff, len(qw) AS query_word_count, len(pw) AS passage_word_count, round(len(qw) / greatest(len(pw), 1), 9) AS word_count_ratio, {part_sql('len(list_intersect(qc, pc))', 'len(qc)')} AS char_overlap_ratio FROM v""")
def lexical_features_adv(spark, sf_dir):
    return featured(spark, sf_dir, pairs.advanced_lexical)


@registered(f"""WITH {PAIRS_CTE}, w AS (SELECT *, {QW} AS qw, {PW} AS pw, strpos(lower(p), lower(q)) AS s FROM pr), f AS (SELECT *, list_filter(list_transform(qw, lambda x: list_position(pw, x)), lambda k: k > 0) AS ix FROM w)
    SELECT query_id, doc_id, CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_match, round(CASE WHEN s > 0 THEN (s - 1) / greatest(length(p), 1) ELSE 0 END, 9)::DOUBLE AS match_position, round(CASE WHEN s > 0 THEN (s - 1) / greatest(length(p) - length(q), 1) ELSE 0 END, 9)::DOUBLE AS match_position_normalized,
    coalesce(qw[1] = pw[1], false)::INT::DOUBLE AS first_word_match, coalesce(qw[-1] = pw[-1], false)::INT::DOUBLE AS last_word_match,
    round(CASE WHEN len(ix) < 2 THEN len(ix) ELSE len(list_filter(range(1, len(ix)), lambda i: ix[i] < ix[i + 1])) / (len(ix) - 1) END, 9)::DOUBLE AS order_preservation FROM f""")
def positional_features(spark, sf_dir):
    return featured(spark, sf_dir, pairs.positional)


@registered(f"""WITH {PAIRS_CTE}, a AS (SELECT query_id, doc_id, unnest({QW}) AS w, generate_subscripts({QW}, 1) AS i FROM pr), b AS (SELECT query_id, doc_id, unnest({PW}) AS w, generate_subscripts({PW}, 1) AS j FROM pr),
    m AS (SELECT query_id, doc_id, j - i AS d, i - row_number() OVER (PARTITION BY query_id, doc_id, j - i ORDER BY i) AS isl FROM a JOIN b USING (query_id, doc_id, w)), r AS (SELECT query_id, doc_id, count(*) AS n FROM m GROUP BY query_id, doc_id, d, isl)
    SELECT h.query_id, h.doc_id, coalesce(max(n), 0) AS run FROM hits h LEFT JOIN r ON r.query_id = h.query_id AND r.doc_id = h.doc_id GROUP BY h.query_id, h.doc_id""")
def max_consecutive(spark, sf_dir):
    return pairs.longest_run(pairs_of(spark, sf_dir))


@registered()
def word_lcs(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    return p.select("query_id", "doc_id", pairs.common_subsequence(pairs.words_of(F.col("query")), pairs.words_of(F.col("text"))).alias("lcs"))


TEST_FAMILIES = {"articles": "the|der|die|la|le|el", "pronouns": "he|she|it|er|sie|que"}
TEST_ENDINGS = ["the.", "tion.", "s.", "er.", "e."]


def language_sql() -> str:
    border = r"[^\p{L}\p{N}_]"

    def count(t: str, v: str) -> str:
        # A border on either side may serve two words, so words are taken one by one.
        return rf"len(list_filter(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '{v}')))"

    cols = []
    for name, v in TEST_FAMILIES.items():
        cols.append(f"{count('lower(q)', v)} AS query_{name}_count, {count('lower(p)', v)} AS passage_{name}_count, least({count('lower(q)', v)}, {count('lower(p)', v)}) AS {name}_overlap")
    for name, v in pairs.SIGNS.items():
        a, b = (f"len(regexp_extract_all(lower({t}), '{v}'))" for t in "qp")
        cols.append(f"{a} AS query_{name}_count, {b} AS passage_{name}_count, least({a}, {b}) AS {name}_overlap")
    dens = lambda t: f"len(regexp_extract_all({t}, '[{text.FOLD_FROM}]')) / greatest(length({t}), 1)"
    ends = lambda t: "CAST(" + " + ".join(f"ends_with(lower({t}), '{e}')::INT" for e in TEST_ENDINGS) + " AS BIGINT)"
    return f"WITH {PAIRS_CTE} SELECT query_id, doc_id, {', '.join(cols)}, round({dens('q')}, 9) AS query_diacritic_density, round({dens('p')}, 9) AS passage_diacritic_density, round(abs({dens('q')} - {dens('p')}), 9) AS diacritic_density_diff, {ends('q')} AS query_endings, {ends('p')} AS passage_endings FROM pr"


@registered(language_sql())
def language_features(spark, sf_dir):
    return featured(spark, sf_dir, lambda q, p: pairs.language_features(q, p, TEST_FAMILIES, TEST_ENDINGS))


@registered(f"""WITH {PAIRS_CTE}, w AS (SELECT query_id, doc_id, list_distinct({QW}) AS a, list_distinct({PW}) AS b FROM pr)
    SELECT query_id, doc_id, CASE WHEN len(a) = 0 THEN 'invalid' WHEN len(list_intersect(a, b)) / len(a) >= 0.8 THEN 'easy' WHEN len(list_intersect(a, b)) / len(a) >= 0.5 THEN 'medium' WHEN len(list_intersect(a, b)) / len(a) >= 0.2 THEN 'hard' ELSE 'very_hard' END AS difficulty FROM w""")
def difficulty_label(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("query_id", "doc_id", pairs.difficulty(F.col("query"), F.col("text")).alias("difficulty"))


def terms_sql(x: str) -> str:
    w = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"
    return f"({w} || CASE WHEN len({w}) >= 2 THEN list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE [] END)"


@registered(rf"""WITH {PAIRS_CTE}, dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents), dt AS (SELECT doc_id, w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS ts FROM dw),
    dtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM dt) GROUP BY doc_id, term), ch AS (SELECT term, count(*) AS df FROM dtf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
    wt AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM ch), wd AS (SELECT doc_id, term, tf * idf AS wd FROM dtf JOIN wt USING (term)),
    qw AS (SELECT query_id, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM qs), qt AS (SELECT query_id, w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS ts FROM qw),
    wq AS (SELECT query_id, term, count(*) * any_value(idf) AS wq FROM (SELECT query_id, unnest(ts) AS term FROM qt) JOIN wt USING (term) GROUP BY query_id, term),
    dot AS (SELECT h.query_id, h.doc_id, sum(wq * wd) AS dot FROM hits h JOIN wq ON wq.query_id = h.query_id JOIN wd ON wd.doc_id = h.doc_id AND wd.term = wq.term GROUP BY h.query_id, h.doc_id),
    nq AS (SELECT query_id, sqrt(sum(wq * wq)) AS n FROM wq GROUP BY query_id), nd AS (SELECT doc_id, sqrt(sum(wd * wd)) AS n FROM wd GROUP BY doc_id)
    SELECT h.query_id, h.doc_id, round(coalesce(dot / (nq.n * nd.n), 0), 6) AS similarity FROM hits h LEFT JOIN dot ON dot.query_id = h.query_id AND dot.doc_id = h.doc_id LEFT JOIN nq ON nq.query_id = h.query_id LEFT JOIN nd ON nd.doc_id = h.doc_id""")
def tfidf_similarity(spark, sf_dir):
    return pairs.weighted_similarity(pairs_of(spark, sf_dir), corpus_of(spark, sf_dir))


@registered(rf"""WITH {QUOTES}, dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM documents), dt AS (SELECT doc_id, w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS ts FROM dw),
    dtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM dt) GROUP BY doc_id, term), ch AS (SELECT term, count(*) AS df FROM dtf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 1000),
    wt AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM ch), wd AS (SELECT doc_id, term, tf * idf AS wd FROM dtf JOIN wt USING (term)),
    qw AS (SELECT query_id, regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM qs), qt AS (SELECT query_id, w || CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS ts FROM qw),
    wq AS (SELECT query_id, term, count(*) * any_value(idf) AS wq FROM (SELECT query_id, unnest(ts) AS term FROM qt) JOIN wt USING (term) GROUP BY query_id, term),
    nq AS (SELECT query_id, sqrt(sum(wq * wq)) AS nq FROM wq GROUP BY query_id), nd AS (SELECT doc_id, sqrt(sum(wd * wd)) AS nd FROM wd GROUP BY doc_id),
    sc AS (SELECT query_id, doc_id, round(sum(wq * wd) / (any_value(nq) * any_value(nd)), 6) AS score FROM wq JOIN wd USING (term) JOIN nq USING (query_id) JOIN nd USING (doc_id) GROUP BY query_id, doc_id) {ranked_sql('sc', 10)}""")
def weighted_topk(spark, sf_dir):
    return pairs.weighted_search(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 10)


# Confirmation

TEST_WORKS = {"one": ["the", "that"], "two": ["der", "die"], "three": ["que.*la", "el"]}
CONF = f"round(least(1.0, 0.5 * contains(lower(p), lower(q))::INT + 0.3 * CASE WHEN len(list_distinct({QW})) > 0 THEN len(list_intersect(list_distinct({QW}), list_distinct({PW}))) / len(list_distinct({QW})) ELSE 0 END + 0.2 * (CASE WHEN greatest(length(q), length(p)) > 0 THEN least(length(q), length(p)) / greatest(length(q), length(p)) ELSE 0 END > 0.3)::INT), 6)::DOUBLE"


@registered(f'WITH {PAIRS_CTE}, c AS (SELECT query_id, doc_id, {CONF} AS confidence FROM pr) SELECT *, confidence > 0.5 AS "match" FROM c')
def confirm_confidence(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("query_id", "doc_id", F.round(pairs.confidence(F.col("query"), F.col("text")), 6).alias("confidence")).withColumn("match", F.col("confidence") > 0.5)


def work_sql() -> str:
    n = {w: " + ".join(f"len(regexp_extract_all(lower(q || ' ' || p), '{x}'))" for x in xs) for w, xs in TEST_WORKS.items()}
    return f"(SELECT query_id, doc_id, q, p, list_max([{', '.join(f"[{c}, {-k}]" for k, c in enumerate(n.values()))}]) AS best FROM pr)"


WORK_CASE = "CASE WHEN best[1] > 0 THEN list_extract([" + ", ".join(f"'{w}'" for w in TEST_WORKS) + "], 1 - best[2]) END"


@registered(f"WITH {PAIRS_CTE} SELECT query_id, doc_id, {WORK_CASE} AS work FROM {work_sql()}")
def confirm_work(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("query_id", "doc_id", pairs.work_named(F.col("query"), F.col("text"), TEST_WORKS).alias("work"))


VERSE = r"coalesce(nullif(regexp_extract(p, '//([^/]+)//', 1), ''), CASE WHEN regexp_matches(p, '\d+\.\d+') THEN regexp_extract(p, '(\d+)\.(\d+)', 1) || '.' || regexp_extract(p, '(\d+)\.(\d+)', 2) END)"


@registered(f"""WITH {PAIRS_CTE}, c AS (SELECT query_id, w.doc_id, {CONF} AS confidence, coalesce({WORK_CASE}, source) AS predicted_work, lang AS predicted_category, {VERSE} AS predicted_verse FROM {work_sql()} w JOIN documents d ON d.doc_id = w.doc_id),
    m AS (SELECT *, confidence > 0.5 AS "match", max((confidence > 0.5)::INT) OVER (PARTITION BY query_id) AS any_match FROM c)
    SELECT query_id, doc_id, confidence, predicted_work, predicted_category, predicted_verse, "match", 'confidence ' || format('{{:.3f}}', confidence) || '; work ' || predicted_work || coalesce('; verse ' || predicted_verse, '') AS reasoning, rank
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, doc_id) AS INT) AS rank FROM m WHERE "match" OR any_match = 0) WHERE rank <= 3""")
def confirm_filter(spark, sf_dir):
    p = pairs_of(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("work"), F.col("lang").alias("category")), "doc_id")
    return pairs.keep_confirmed(pairs.confirmed(p, TEST_WORKS), 3).select("query_id", "doc_id", "confidence", "predicted_work", "predicted_category", "predicted_verse", "match", "reasoning", "rank")


@registered(f"""WITH {PAIRS_CTE}, c AS (SELECT ({CONF} > 0.5) = (query_id % 2 = 0) AS ok FROM pr) SELECT round(avg(ok::INT), 6) AS accuracy, CAST(sum(ok::INT) AS BIGINT) AS "right", count(*) AS total FROM c""")
def filter_accuracy(spark, sf_dir):
    return pairs.filter_accuracy(pairs_of(spark, sf_dir).withColumns({"work": F.lit("x"), "category": F.lit("y"), "expected_match": F.col("query_id") % 2 == 0}))


@registered("SELECT conv_id, turn, CAST(unnest(range(1, 4)) AS INT) AS passage, unnest(CASE WHEN turn % 3 = 2 THEN [6.0, 6.0, 6.0] ELSE [(conv_id % 10)::DOUBLE, 5.0, (turn + 1)::DOUBLE] END)::DOUBLE AS score FROM conversations")
def llm_parse(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    answer = F.format_string('```json\n{"evaluations": [{"passage_number": 1, "relevance_score": %d, "explanation": "x", "key_concepts": ["a"]}, {"passage_number": 3, "relevance_score": %d}]}\n```', F.col("conv_id") % 10, F.col("turn") + 1)
    scores = pairs.parsed_answer(F.when(F.col("turn") % 3 == 2, F.lit("I cannot say.")).otherwise(answer), F.lit(3))
    return turns.select("conv_id", "turn", F.posexplode(scores).alias("k", "score")).select("conv_id", "turn", (F.col("k") + 1).alias("passage"), "score")


# Datasets


def lot_sql(name: str) -> str:
    return f"CAST('0x' || substr(md5('42|' || doc_id || '|{name}'), 1, 15) AS BIGINT)"


@registered(f"""WITH w AS (SELECT doc_id, {tok('text')} AS w, len({tok('text')}) AS n FROM documents), f AS (SELECT doc_id, w, n, least(5, n // 2) AS k, {', '.join(f"3 + {lot_sql(f'size{j}')} % greatest(least(7, n - 1) - 2, 1) AS z{j}" for j in range(3))} FROM w WHERE n >= 4),
    v AS (SELECT doc_id, unnest(list_distinct([array_to_string(w, ' '), array_to_string(w[1:n // 4], ' '), array_to_string(w[1:n // 2], ' '), array_to_string(w[1:3 * n // 4], ' '), array_to_string(w[n // 2 + 1:n], ' '), array_to_string(w[n // 4 + 1:3 * n // 4], ' ')]
        || list_transform(range(0, n - k + 1, 2), lambda i: array_to_string(w[i + 1:i + k], ' '))
        || CASE WHEN n >= 8 THEN [{', '.join(f"array_to_string(w[{lot_sql(f'start{j}')} % (n - z{j} + 1) + 1:{lot_sql(f'start{j}')} % (n - z{j} + 1) + z{j}], ' ')" for j in range(3))}] ELSE [] END)) AS variant FROM f)
    SELECT doc_id, variant FROM v WHERE variant <> ''""")
def query_variants(spark, sf_dir):
    return datasets.query_variants(docs_of(spark, sf_dir))


@registered()
def positive_pairs(spark, sf_dir):
    return datasets.positive_pairs(docs_of(spark, sf_dir)).drop("passage")


def negatives_sql() -> str:
    first = lambda name, keys, order, group: f"{name} AS (SELECT *, row_number() OVER ({group} ORDER BY {order}) - 1 AS place, count(*) OVER ({group}) AS members FROM (SELECT {keys}, m.lot AS lot, m.doc_id AS doc_id, m.n AS n FROM (SELECT {keys}, min(struct_pack(lot := lot, doc_id := doc_id, n := n)) AS m FROM nb WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keys.split(', '))} GROUP BY {keys})))"
    pick = "SELECT doc_id, other_id, '{0}' AS kind FROM (SELECT doc_id, other_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM ({1})) WHERE r <= 2"
    work = "SELECT a.doc_id, b.doc_id AS other_id, k FROM (SELECT x.doc_id, x.content, x.source, place, members, unnest(range(0, least(2, members - 1))) AS k FROM wt x JOIN wk USING (source, content)) a JOIN wk b ON a.source = b.source AND b.place = (a.place + k + 1) % a.members WHERE a.content <> b.content"
    category = """SELECT a.doc_id, b.doc_id AS other_id, k FROM (SELECT x.doc_id, x.lang, x.content, drawn, b0, own, members, members - own AS others, unnest(range(0, least(members - own, 2 + alike))) AS k FROM wt x JOIN cb USING (lang, source) JOIN ca USING (lang, content)) a
        JOIN ct b ON a.lang = b.lang AND b.place = (b0 + own + (drawn + k) % others) % a.members WHERE a.content <> b.content"""
    length = "SELECT a.doc_id, b.doc_id AS other_id, k FROM (SELECT x.doc_id, x.content, drawn, b0, many, unnest(range(0, least(many, 3))) AS k FROM wt x JOIN nr USING (n)) a JOIN ln b ON b.place = b0 + (drawn + k) % many WHERE a.content <> b.content"
    return f"""WITH nb AS (SELECT doc_id, md5(text) AS content, source, lang, length(text) AS n, md5('42|' || doc_id) AS lot FROM documents WHERE text IS NOT NULL),
        wt AS (SELECT *, CAST('0x' || substr(lot, 1, 15) AS BIGINT) AS drawn FROM nb WHERE doc_id % 50 = 0),
        {first('wk', 'source, content', 'lot, doc_id', 'PARTITION BY source')}, {first('ct', 'lang, source, content', 'source, lot, doc_id', 'PARTITION BY lang')}, {first('ln', 'content', 'n, lot, doc_id', '')}, {first('ev', 'content', 'lot, doc_id', '')},
        cb AS (SELECT lang, source, min(place) AS b0, count(*) AS own, max(members) AS members FROM ct GROUP BY lang, source), ca AS (SELECT lang, content, count(*) AS alike FROM ct GROUP BY lang, content),
        nr AS (SELECT w.n AS n, count(*) FILTER (l.n < w.n * 0.7::DOUBLE) AS b0, count(*) FILTER (l.n <= w.n * 1.3::DOUBLE) - count(*) FILTER (l.n < w.n * 0.7::DOUBLE) AS many FROM (SELECT DISTINCT n FROM wt) w, ln l GROUP BY w.n),
        chosen AS ({pick.format('same_work', work)} UNION ALL {pick.format('same_category', category)} UNION ALL {pick.format('similar_length', length)}),
        cn AS (SELECT doc_id, content, 6 - coalesce(got, 0) AS need FROM wt LEFT JOIN (SELECT doc_id, count(*) AS got FROM chosen GROUP BY doc_id) USING (doc_id) WHERE coalesce(got, 0) < 6),
        rf AS (SELECT a.doc_id, b.doc_id AS other_id, k, need FROM (SELECT cn.doc_id, content, need, place, members, unnest(range(0, least(members - 1, need + 6))) AS k FROM cn JOIN ev USING (content)) a JOIN ev b ON b.place = (a.place + k + 1) % a.members)
        SELECT * FROM chosen UNION ALL SELECT doc_id, other_id, 'random' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM rf ANTI JOIN chosen USING (doc_id, other_id)) WHERE r <= need"""


@registered(negatives_sql())
def hard_negatives(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return datasets.hard_negatives(docs, docs.filter("doc_id % 50 = 0"))


@registered("""WITH g AS (SELECT doc_id, text, r AS ratio, s AS "start", CAST(floor(length(text) * r) AS BIGINT) AS size FROM documents, (SELECT unnest([0.2, 0.35, 0.5, 0.65]::DOUBLE[]) AS r), (SELECT unnest([0.0, 0.25, 0.5]::DOUBLE[]) AS s)),
    q AS (SELECT doc_id, ratio, "start", trim(substr(text, CAST(floor((length(text) - size) * "start") AS BIGINT) + 1, size), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS query FROM g) SELECT * FROM q WHERE length(query) > 15""")
def exact_match_grid(spark, sf_dir):
    return datasets.exact_grid(docs_of(spark, sf_dir))


@registered("""WITH z AS (SELECT doc_id, text, r AS ratio, CAST(floor(length(text) * r) AS BIGINT) AS size FROM documents, (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS r)), s AS (SELECT doc_id, text, ratio, size, unnest(range(0, length(text) - size + 1, greatest(1, size // 2))) AS st FROM z WHERE size > 10)
    SELECT doc_id, ratio, CAST(st AS INT) AS "start", substr(text, st + 1, size) AS query FROM s""")
def exact_match_exhaustive(spark, sf_dir):
    return datasets.exact_everywhere(corpus_of(spark, sf_dir))


SUBSTITUTES = {"the": ["of", "and"], "der": ["die"]}


def drawn_sql(n: str, *keys: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN CAST('0x' || substr(md5(concat_ws('|', '42', {', '.join(keys)})), 1, 15) AS BIGINT) % {n} ELSE 0 END)"


@registered(f"""WITH w AS (SELECT doc_id, {tok('text')} AS w, unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS query_coverage FROM documents), n AS (SELECT *, greatest(2, CAST(floor(len(w) * query_coverage) AS BIGINT)) AS n FROM w WHERE len(w) >= 6),
    s AS (SELECT *, {drawn_sql('(len(w) - n + 1)', 'doc_id', 'query_coverage')} AS st FROM n) SELECT doc_id, query_coverage, array_to_string(w[st + 1:st + n], ' ') AS query FROM s""")
def exact_spans(spark, sf_dir):
    return testsets.exact_spans(docs_of(spark, sf_dir))


@registered(f"""WITH d AS (SELECT doc_id, {tok('text')} AS words, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS members FROM documents), e AS (SELECT a.doc_id, a.words, b.words AS other FROM d a JOIN d b ON b.place = (a.place + 1) % a.members WHERE len(a.words) >= 6),
    r AS (SELECT *, unnest([4, 6, 8, 10]) AS query_length FROM (SELECT *, unnest([0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS overlap_ratio FROM e)), o AS (SELECT *, greatest(1, CAST(floor(query_length * overlap_ratio) AS INT)) AS own, len(words) AS n FROM r WHERE query_length < len(words)),
    s AS (SELECT *, greatest(n // own, 1) AS step, {drawn_sql('n', 'doc_id', 'overlap_ratio', 'query_length', "'own'")} AS st FROM o),
    t AS (SELECT *, [words[(st + k * step) % n + 1] FOR k IN range(0, own)] AS taken, [other[{drawn_sql('len(other)', 'doc_id', 'overlap_ratio', 'query_length', "'other'", 'k')} + 1] FOR k IN range(1, query_length - own + 1)] AS picked FROM s),
    b AS (SELECT *, taken || [x FOR x IN picked IF x IS NOT NULL AND NOT list_contains(taken, x)] AS words2 FROM t),
    u AS (SELECT doc_id, overlap_ratio, query_length, unnest(words2) AS x, generate_subscripts(words2, 1) - 1 AS k FROM b),
    v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, overlap_ratio, query_length ORDER BY md5(concat_ws('|', doc_id, overlap_ratio, query_length, x, k)), k) AS r FROM u),
    q AS (SELECT doc_id, overlap_ratio, query_length, string_agg(x, ' ' ORDER BY r) AS query FROM v WHERE r <= query_length GROUP BY doc_id, overlap_ratio, query_length)
    SELECT *, CASE WHEN overlap_ratio >= 0.6 THEN 'medium-high' WHEN overlap_ratio >= 0.4 THEN 'medium' ELSE 'low-medium' END AS expected_score, CASE WHEN overlap_ratio >= 0.4 THEN 'medium' ELSE 'hard' END AS difficulty FROM q WHERE length(trim(query, ' ')) > 10""")
def partial_matches(spark, sf_dir):
    return testsets.partial_matches(docs_of(spark, sf_dir))


@registered(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS term, '{s}' AS related, '{c}' AS context, '{c} {s}' AS query FROM documents WHERE contains(lower(text), '{k}')" for k, ss in SUBSTITUTES.items() for s in ss for c in testsets.CONTEXTS))
def context_queries(spark, sf_dir):
    return testsets.context_queries(docs_of(spark, sf_dir), SUBSTITUTES)


@registered(f"""WITH t AS (SELECT content, m.lot AS lot, m.doc_id AS doc_id FROM (SELECT md5(text) AS content, min(struct_pack(lot := md5('42|' || doc_id), doc_id := doc_id)) AS m FROM documents WHERE text IS NOT NULL GROUP BY md5(text))), r AS (SELECT *, row_number() OVER (ORDER BY lot, doc_id) - 1 AS place, count(*) OVER () AS members FROM t),
    a AS (SELECT d.doc_id, place, members, {drawn_sql('(members - 1)', 'd.doc_id', "'random'")} AS st FROM documents d JOIN r ON md5(d.text) = r.content WHERE members > 1)
    SELECT a.doc_id, b.doc_id AS other_id FROM a JOIN r b ON b.place = (a.place + 1 + st % (a.members - 1)) % a.members""")
def random_negatives(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return testsets.random_negatives(docs, docs)


@registered()
def first_test_set(spark, sf_dir):
    return testsets.test_set(docs_of(spark, sf_dir), SUBSTITUTES).select("doc_id", "query", "label", "test_type", "expected_score", "difficulty", "work", "category", "query_coverage", "overlap_ratio", "term", "related", "negative_type", F.md5("passage").alias("passage_md5"))


@registered()
def large_test_set(spark, sf_dir):
    return testsets.large_set(docs_of(spark, sf_dir), SUBSTITUTES, 1000).select("doc_id", "query", "label", "test_type", "expected_score", "difficulty", "work", "category", "negative_type", F.md5("passage").alias("passage_md5"))


@registered(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS term, '{s}' AS synonym, replace(h, '{k}', '{s}') AS query FROM (SELECT doc_id, {head('lower(text)')} AS h FROM documents) WHERE contains(h, '{k}')" for k, ss in SUBSTITUTES.items() for s in ss))
def semantic_substitutions(spark, sf_dir):
    return datasets.substitutions(docs_of(spark, sf_dir), SUBSTITUTES)


def all_pairs(spark, sf_dir):
    """Half-text queries of all documents that have text, with their own text and with that of the next document in the order of ids."""
    docs = corpus_of(spark, sf_dir).filter("length(text) > 0")
    paired = datasets.with_next(docs).withColumn("query", datasets.first_half(F.col("text")))
    own = paired.select("doc_id", "query", F.col("text").alias("passage"), F.lit(1).alias("label"))
    return own.unionByName(paired.filter("next_text IS NOT NULL").select("doc_id", "query", F.col("next_text").alias("passage"), F.lit(0).alias("label")))


LABELLED_CTE = f"""ld AS (SELECT doc_id, text AS passage, CASE WHEN len({tok('text')}) > 4 THEN array_to_string({tok('text')}[1:len({tok('text')}) // 2], ' ') ELSE text END AS query FROM documents WHERE length(text) > 0),
    lp AS (SELECT doc_id, query AS q, passage AS p, 1 AS label FROM ld UNION ALL SELECT doc_id, query, coalesce(lead(passage) OVER (ORDER BY doc_id, md5(passage)), first(passage) OVER (ORDER BY doc_id, md5(passage))), 0 FROM ld WHERE (SELECT count(*) FROM ld) > 1),
    sc AS (SELECT doc_id, doc_id AS query_id, label, label AS relevance, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS slice, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS model, round(CASE WHEN len(list_distinct({QW})) > 0 THEN len(list_intersect(list_distinct({QW}), list_distinct({PW}))) / len(list_distinct({QW})) ELSE 0 END, 6)::DOUBLE AS score FROM lp)"""


def scored_pairs(spark, sf_dir):
    p = all_pairs(spark, sf_dir)
    score = pairs.basic_lexical(F.col("query"), F.col("passage"))["word_overlap"]
    return p.select("doc_id", F.col("doc_id").alias("query_id"), "label", F.col("label").alias("relevance"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("slice"), F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("model"), F.round(score, 6).alias("score"))


@registered(f"""WITH {LABELLED_CTE}, l AS (SELECT doc_id, q AS query, label, CASE WHEN label = 1 THEN 'easy' ELSE 'hard' END AS difficulty FROM lp), c AS (SELECT *, count(*) OVER (PARTITION BY query) AS group_size FROM l)
    SELECT doc_id, label, group_size, CAST(CASE WHEN label = 1 THEN 2 ELSE 0 END AS INT) AS relevance FROM c WHERE group_size >= 2""")
def ltr_groups(spark, sf_dir):
    p = all_pairs(spark, sf_dir).withColumn("difficulty", F.when(F.col("label") == 1, "easy").otherwise("hard"))
    return datasets.ltr_groups(p).select("doc_id", "label", "group_size", "relevance")


@registered(f"""WITH {LABELLED_CTE}, l AS (SELECT doc_id, q, p, label, CASE WHEN doc_id % 3 = 0 THEN 'easy' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty, md5('42|' || doc_id || '|' || q) AS lot FROM lp),
    pos AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY lot, doc_id, q) > CASE difficulty WHEN 'easy' THEN 9 WHEN 'medium' THEN 12 ELSE 9 END AS late FROM l WHERE label = 1),
    pt AS (SELECT doc_id, label, difficulty FROM pos ORDER BY late, lot, doc_id, q LIMIT 30), nt AS (SELECT doc_id, label, difficulty FROM l WHERE label = 0 ORDER BY md5('42|' || doc_id || '|' || q || '|' || p), doc_id, q LIMIT 70)
    SELECT * FROM pt UNION ALL SELECT * FROM nt""")
def balanced_pairs(spark, sf_dir):
    p = all_pairs(spark, sf_dir).withColumn("difficulty", F.when(F.col("doc_id") % 3 == 0, "easy").when(F.col("doc_id") % 3 == 1, "medium").otherwise("hard"))
    return datasets.balanced(p.filter("label = 1"), p.filter("label = 0"), 100).select("doc_id", "label", "difficulty")


# Metrics

TRUTH_CTE = "tr AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def truth_of(spark, sf_dir):
    """The documents that hold an item's text."""
    return search.holding(corpus_of(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")))


@registered(f"WITH {QUOTES}, {BM25_CTE}, h AS ({ranked_sql('bm', 100)}), {TRUTH_CTE}, b AS (SELECT query_id, min(rank) AS rank FROM tr LEFT JOIN h USING (query_id, doc_id) GROUP BY query_id) SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall FROM b, (SELECT unnest([1, 5, 10, 20, 50, 100]) AS k) GROUP BY k")
def recall_at_k(spark, sf_dir):
    return metrics.recall_at(search.bm25(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 100), truth_of(spark, sf_dir))


@registered(f"WITH {QUOTES}, {BM25_CTE}, h AS ({ranked_sql('bm', 100)}), {TRUTH_CTE}, b AS (SELECT query_id, min(rank) AS rank FROM tr LEFT JOIN h USING (query_id, doc_id) GROUP BY query_id) SELECT round(avg(coalesce(1 / rank, 0)), 6) AS mrr, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS precision_1 FROM b")
def mrr_p1(spark, sf_dir):
    return metrics.reciprocal(search.bm25(corpus_of(spark, sf_dir), quotes_of(spark, sf_dir), 100), truth_of(spark, sf_dir))


def classification_sql(by: str = "") -> str:
    k = by + ", " if by else ""
    return f"""(SELECT {k}n, round(rt / n, 6) AS accuracy, round(CASE WHEN sd > 0 THEN tp / sd ELSE 0 END, 6)::DOUBLE AS "precision", round(CASE WHEN tt > 0 THEN tp / tt ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN sd + tt > 0 THEN 2 * tp / (sd + tt) ELSE 0 END, 6)::DOUBLE AS f1
        FROM (SELECT {k}count(*) AS n, sum(((score >= 0.5) = (label = 1))::INT) AS rt, sum((score >= 0.5 AND label = 1)::INT) AS tp, sum((score >= 0.5)::INT) AS sd, sum(label) AS tt FROM sc GROUP BY {by or 'ALL'}))"""


@registered(f"WITH {LABELLED_CTE} SELECT * FROM {classification_sql()}")
def classification_metrics(spark, sf_dir):
    return metrics.classification(scored_pairs(spark, sf_dir))


@registered(f"WITH {LABELLED_CTE} SELECT * FROM {classification_sql('slice')}")
def metrics_by_slice(spark, sf_dir):
    return metrics.classification(scored_pairs(spark, sf_dir), ["slice"])


@registered(f"WITH {LABELLED_CTE} SELECT model, round(accuracy, 4) AS accuracy, round(\"precision\", 4) AS \"precision\", round(recall, 4) AS recall, round(f1, 4) AS f1, row_number() OVER (ORDER BY round(f1, 4) DESC, model) = 1 AS best FROM {classification_sql('model')}")
def model_compare(spark, sf_dir):
    return metrics.compare_models(scored_pairs(spark, sf_dir))


@registered(f"""WITH {LABELLED_CTE}, pt AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS m FROM sc GROUP BY score), bt AS (SELECT *, coalesce(sum(m) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pt)
    SELECT round(sum(p * (below + m / 2)) / (sum(p) * sum(m)), 6)::DOUBLE AS auc FROM bt""")
def auc(spark, sf_dir):
    return metrics.auc(scored_pairs(spark, sf_dir))


@registered(f"""WITH {LABELLED_CTE}, m AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS many, row_number() OVER (PARTITION BY query_id ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS i, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS fr, avg(relevance) OVER (PARTITION BY query_id, score) AS g FROM sc),
    s AS (SELECT query_id, sum(CASE WHEN r <= 5 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 5 THEN relevance / log2(i + 1) ELSE 0 END) AS best, min(CASE WHEN relevance > 0 THEN fr END) AS hit FROM m WHERE many >= 2 GROUP BY query_id)
    SELECT round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0 END), 6) AS ndcg, round(avg(coalesce(1 / hit, 0)), 6) AS mrr, round(avg((coalesce(hit, 0) = 1)::INT), 6) AS precision_1 FROM s""")
def ndcg_at_5(spark, sf_dir):
    return metrics.ranking(scored_pairs(spark, sf_dir))


# Models and the whole way

BASIC = ["word_overlap", "jaccard", "query_length", "passage_length", "length_ratio", "char_overlap", "exact_match", "match_position", "word_lcs", "word_similarity", "char_similarity"]


def learning_rows(spark, sf_dir, featured_by=pairs.basic_features):
    """The pairs of all documents with features; a passage is named by its document's id and whether it is the right one."""
    p = all_pairs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), (F.col("doc_id") * 2 + F.col("label")).alias("doc_id"), "query", F.col("passage").alias("text"), F.col("label").cast("double").alias("label"), F.col("label").alias("relevance"))
    p = p.persist()  # features read the texts several times
    return featured_by(p, p.select("doc_id", "text"))


def learned(spark, sf_dir, fit, featured_by=pairs.basic_features, features=BASIC):
    rows = learning_rows(spark, sf_dir, featured_by)
    # Rounds of a fit are many short jobs over a few numbers a row: as many partitions as cores, in an order of their own.
    rows = rows.select("query_id", "doc_id", "label", "relevance", *features).repartition(spark.sparkContext.defaultParallelism, "query_id").sortWithinPartitions("query_id", "doc_id").persist()
    train, test = models.split(rows, ["query_id"])
    return models.ranked(fit(train), test).select("query_id", "doc_id", "label", "ranking_score", "final_rank")


ADVANCED = [
    "word_overlap_ratio", "jaccard_similarity", "dice_coefficient", "short_word_overlap", "long_word_overlap", "query_length", "passage_length", "length_ratio", "length_diff", "query_word_count", "passage_word_count", "word_count_ratio", "char_overlap_ratio",
    "word_similarity", "char_similarity", "phrase_similarity", "mean_similarity",
    "exact_match", "match_position", "match_position_normalized", "first_word_match", "last_word_match", "order_preservation", "word_lcs", "max_consecutive",
    *[f"{side}{f}{end}" for f in [*pairs.FAMILIES, *pairs.SIGNS] for side, end in (("query_", "_count"), ("passage_", "_count"), ("", "_overlap"))],
    "query_diacritic_density", "passage_diacritic_density", "diacritic_density_diff", "query_endings", "passage_endings",
]


@registered()
def rf_rank(spark, sf_dir):
    return learned(spark, sf_dir, lambda rows: models.fit_forest(rows, BASIC, trees=100, depth=10))


@registered()
def gbt_rank(spark, sf_dir):
    return learned(spark, sf_dir, lambda rows: models.fit_boosted(rows, BASIC))


@registered()
def ltr_pairwise_rank(spark, sf_dir):
    return learned(spark, sf_dir, lambda rows: models.fit_pairwise(rows, BASIC))


@registered()
def basic_features_all(spark, sf_dir):
    """The 11 features of the five best hits of each quote."""
    return pairs.basic_features(pairs_of(spark, sf_dir), corpus_of(spark, sf_dir)).drop("query", "text")


@registered()
def advanced_features_all(spark, sf_dir):
    """The 45 features of the five best hits of each quote."""
    return pairs.advanced_features(pairs_of(spark, sf_dir), corpus_of(spark, sf_dir)).drop("query", "text")


@registered(f"""WITH {fused_sql(10)}, v AS (SELECT fused.query_id, fused.doc_id, query AS q, coalesce(text, '') AS p, round(1.0 - 0.1 * (rank - 1), 6)::DOUBLE AS ranking_score FROM fused JOIN qs USING (query_id) JOIN documents d ON d.doc_id = fused.doc_id),
    c AS (SELECT query_id, doc_id, ranking_score, {CONF} AS confidence FROM v), m AS (SELECT *, confidence > 0.5 AS "match", max((confidence > 0.5)::INT) OVER (PARTITION BY query_id) AS any_match FROM c)
    SELECT query_id, doc_id, ranking_score, confidence, "match" FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, doc_id) AS r FROM m WHERE "match" OR any_match = 0) WHERE r = 1""")
def pipeline_end_to_end(spark, sf_dir):
    docs, queries = corpus_of(spark, sf_dir), quotes_of(spark, sf_dir)
    hits = search.fused_search(docs, queries, 10, TEST_SYNONYMS, wide=True)
    full = models.untrained(scans.few(hits, queries).join(docs, "doc_id").join(queries, "query_id")).withColumns({"work": F.lit(None).cast("string"), "category": F.lit(None).cast("string")})
    return pairs.keep_confirmed(pairs.confirmed(full.drop("rank")), 1).select("query_id", "doc_id", "ranking_score", "confidence", "match")


@registered()
def text_processed(spark, sf_dir):
    made = text.preprocessed(docs_of(spark, sf_dir).select("doc_id", "text"), prefixes=TEST_PREFIXES, suffixes=TEST_SUFFIXES)
    return made.select("doc_id", "cleaned", "iast", "ascii", "length", F.array_join("split_words", " ").alias("split_words"), "lemmas_text", "indexed")


def word_model(prompt: str) -> str:
    """A stand-in for a model: the score of a passage is how many words of six letters or more it shares with the query, ten at most."""
    import json
    import re

    asked, listed = prompt.split('Query: "', 1)[1], re.findall(r"(?m)^(\d+)\. (.*)$", prompt)
    words = {w for w in asked.split('"\n', 1)[0].lower().split() if len(w) >= 6}
    return json.dumps({"evaluations": [{"passage_number": int(k), "relevance_score": min(10, len(words & set(t.lower().split())))} for k, t in listed]})


@registered()
def engine_answers(spark, sf_dir):
    """The web search as an API: each quote's ten first of 128 hits, the first 20 scored by a stand-in for a model."""
    return Engine(spark, docs_of(spark, sf_dir), TEST_SYNONYMS).answer(quotes_of(spark, sf_dir), ask=word_model).drop("text")


@registered()
def pipeline_measures(spark, sf_dir):
    asked = quotes_of(spark, sf_dir)
    return metrics.pipeline_measures(asked, Engine(spark, docs_of(spark, sf_dir), TEST_SYNONYMS).retrieve(asked, 20))


@registered()
def engine_retrieve(spark, sf_dir):
    engine = Engine(spark, docs_of(spark, sf_dir), TEST_SYNONYMS)
    return engine.retrieve(quotes_of(spark, sf_dir), 20).select("query_id", "doc_id", "score", "confidence", "match", "predicted_work")
