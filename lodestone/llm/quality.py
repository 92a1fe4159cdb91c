"""Quality rules whose thresholds follow each language and source.

Fixed rules come first.  The other rules look at rates of a document, such as signs in a thousand words, and
reject what lies far outside the rates that documents of the same language and source have.  The rates of a group are kept in a
quantile sketch: counts by bucket, a bucket for every value up to 31 and for every five leading bits beyond.  Sketches of
sources add up to that of their language, and those to that of the corpus; a small group uses the next wider one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD_GAP, keep_table, text_of

#: For each rate the least spread that counts, and whether low values are suspect too.
RATES = {"symbol_rate": (30, False), "dup_line_rate": (100, False), "upper_rate": (100, False), "word_length": (100, True)}
#: Spreads beyond the quartiles that are still taken as usual.
REACH = 3
#: Documents that a group needs for thresholds of its own, by default; a smaller group takes those of its language, or else of the corpus.
ENOUGH = 50


def base_counts(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text, from its words and lines; one pass, and no shuffle.

    Words repeated in windows of five are found by the windows' hashes: a text whose hashes all differ
    has none, and only for the others are the hashes sorted with their places.
    """
    text = text_of(docs)
    first = docs.select(
        "doc_id", *extra, F.array_remove(F.split(text, WORD_GAP), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    word = lambda i: F.get("words", i)
    windows = F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(0), F.size("words") - 5), lambda i: F.xxhash64(*[word(i + k) for k in range(5)]))).otherwise(F.array().cast("array<long>"))
    kept = ["doc_id", *extra, "n_symbols", "n_upper"]
    second = first.select(
        *kept, F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    kept += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    third = second.select(*kept, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda x, k, step: F.coalesce(F.get("sorted", k + step)["h"] == x["h"], F.lit(False))
    fourth = third.select(*kept, F.sort_array(F.transform(F.filter("sorted", lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - x, F.lit(5)))), F.lit(0).cast("int"), lambda a, x: a + x)
    return fourth.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def judged(counts: DataFrame) -> DataFrame:
    """The counts with the rates, as whole numbers, and the verdict of the fixed rules."""
    rate = lambda over, under, times: F.when(F.col(under) > 0, F.expr(f"{times} * {over} div {under}")).otherwise(F.lit(0)).cast("long")
    return counts.withColumns(
        {
            "symbol_rate": rate("n_symbols", "n_words", 1000),
            "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
            "upper_rate": rate("n_upper", "word_chars", 1000),
            "word_length": rate("word_chars", "n_words", 100),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )


def bucket(v: Column) -> Column:
    """The least value of the bucket of ``v``: itself up to 31, else its five leading bits."""
    step = F.expr("shiftleft(1L, greatest(length(bin(v)) - 5, 0))")
    return v - F.pmod(v, step)


def sketches(rows: DataFrame) -> DataFrame:
    """The quantile sketch of each language and source: lang, source, rate, bucket, n."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in RATES]))
    return rows.filter(~F.col("base_failed")).select("lang", "source", rates.alias("x")).select("lang", "source", "x.rate", "x.v").select("lang", "source", "rate", bucket(F.col("v")).alias("bucket")).groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches merged by ``by``, and the usual range of each rate: its quartiles, and ``REACH`` spreads beyond."""
    merged = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rate")
    running = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("bucket")))
    found = running.groupBy(*by, "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("all").alias("members"))
    ends = []
    for r, (least, _) in RATES.items():
        one = lambda c, r=r: F.max(F.when(F.col("rate") == r, F.col(c)))
        spread = REACH * F.greatest(one("q3") - one("q1"), F.lit(least))
        ends += [(one("q1") - spread).alias(f"{r}_low"), (one("q3") + spread).alias(f"{r}_high")]
    return found.groupBy(*by).agg(F.max("members").alias("members"), *ends)


def thresholds(rows: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The range of each rate for every language and source among ``rows``."""
    sketch = sketches(rows)
    own, lang, every = fences(sketch, ["lang", "source"]).alias("o"), fences(sketch, ["lang"]).alias("l"), fences(sketch.withColumn("one", F.lit(1)), ["one"]).alias("e")
    groups = rows.select("lang", "source").distinct().withColumn("one", F.lit(1)).alias("g")
    same = lambda a, b, c: F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    joined = groups.join(own, same("g", "o", "lang") & same("g", "o", "source"), "left").join(lang, same("g", "l", "lang"), "left").join(every, F.col("g.one") == F.col("e.one"), "left")
    pick = lambda c: F.when(F.col("o.members") >= enough, F.col(f"o.{c}")).when(F.col("l.members") >= enough, F.col(f"l.{c}")).otherwise(F.col(f"e.{c}"))
    return joined.select("g.lang", "g.source", *[pick(f"{r}_{end}").alias(f"{r}_{end}") for r in RATES for end in ("low", "high")])


def quality_verdicts(docs: DataFrame, *more: str, enough: int = ENOUGH) -> DataFrame:
    """A row for each row of ``docs(doc_id, text, lang, source)``: its counts, rates, base_failed and kept.

    Null texts have no word and so fail; null languages and sources are groups of their own.  Rows that repeat
    count each time.  An empty table gives none, other columns are ignored, and texts of any length are read whole.  Thresholds are those of the language and source
    where these have ``enough`` documents that pass the fixed rules.
    """
    rows = keep_table(judged(base_counts(docs, ("lang", "source", *more))), "quality")
    limits = thresholds(rows, enough)
    usual = reduce(
        lambda a, b: a & b,
        [F.col(f"r.{r}") <= F.col(f"t.{r}_high") for r in RATES] + [F.col(f"r.{r}") >= F.col(f"t.{r}_low") for r, (_, low) in RATES.items() if low],
    )
    joined = rows.alias("r").join(limits.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source")), "left")
    return joined.select("r.*", (~F.col("r.base_failed") & F.coalesce(usual, F.lit(True))).alias("kept"))


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each by its own verdict: null ids too, and of rows with the same id those kept.

    Rows with the same id, language, source and text have the same verdict.
    """
    names = ["doc_id", "lang", "source", "text_digest"]
    marked = docs.withColumn("text_digest", F.sha2(text_of(docs), 256))
    kept = quality_verdicts(marked, "text_digest").filter("kept").select(*[F.col(c).alias(f"kept_{c}") for c in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"kept_{c}")) for c in names])
    return marked.join(kept, same, "left_semi").drop("text_digest")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)


def _sql() -> str:
    rate = lambda r: {"symbol_rate": "1000 * n_symbols // n_words", "dup_line_rate": "1000 * n_dup_lines // n_lines", "upper_rate": "1000 * n_upper // word_chars", "word_length": "100 * word_chars // n_words"}[r]
    under = lambda r: rate(r).split(" // ")[1]
    rates = ",\n".join(f"CASE WHEN {under(r)} > 0 THEN {rate(r)} ELSE 0 END AS {r}" for r in RATES)
    buckets = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} - {r} % (1::BIGINT << greatest(length(bin({r})) - 5, 0)) AS bucket FROM j WHERE NOT base_failed" for r in RATES)

    def level(by: str) -> str:
        keys = by + ", " if by else ""
        ends = ", ".join(f"max(q1) FILTER (rate = '{r}') - {REACH} * greatest(max(q3 - q1) FILTER (rate = '{r}'), {least}) AS {r}_low, max(q3) FILTER (rate = '{r}') + {REACH} * greatest(max(q3 - q1) FILTER (rate = '{r}'), {least}) AS {r}_high" for r, (least, _) in RATES.items())
        return f"""(SELECT {keys}max(members) AS members, {ends} FROM (
            SELECT {keys}rate, min(bucket) FILTER (4 * upto >= alln) AS q1, min(bucket) FILTER (4 * upto >= 3 * alln) AS q3, max(alln) AS members FROM (
                SELECT {keys}rate, bucket, sum(n) OVER (PARTITION BY {keys}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}rate) AS alln FROM (
                    SELECT {keys}rate, bucket, count(*) AS n FROM b GROUP BY {keys}rate, bucket)) GROUP BY {keys}rate) GROUP BY {by or 'ALL'})"""

    pick = lambda c: f"CASE WHEN o.members >= {ENOUGH} THEN o.{c} WHEN l.members >= {ENOUGH} THEN l.{c} ELSE e.{c} END"
    usual = " AND ".join([f"j.{r} <= {pick(f'{r}_high')}" for r in RATES] + [f"j.{r} >= {pick(f'{r}_low')}" for r, (_, low) in RATES.items() if low])
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
w AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w) WHERE n > 1),
rep AS (SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g) GROUP BY r),
c AS (SELECT doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
             CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM t LEFT JOIN rep USING (r)),
j AS (SELECT *, {rates}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
b AS ({buckets}),
o AS {level("lang, source")}, l AS {level("lang")}, e AS {level("")}
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, NOT j.base_failed AND coalesce({usual}, true) AS kept
FROM j LEFT JOIN o ON j.lang IS NOT DISTINCT FROM o.lang AND j.source IS NOT DISTINCT FROM o.source LEFT JOIN l ON j.lang IS NOT DISTINCT FROM l.lang LEFT JOIN e ON true
"""


OP9_SQL = _sql()
