"""Mixing sources to target weights along a curriculum.

Every source has a weight that changes over the training run, a straight line from its start to its end
value.  The integral of that schedule, scaled to the source's target, is the demand for its words up to a
moment; the inverse of that demand turns a word's place in the source's stream into a training position.
The mix is the documents in order of position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD_GAP, keep_table, text_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Weights rise or fall by this part over the run, in turns by source.
TILT = 0.5
#: Hexadecimal digits of the digest that cut a source's stream into runs.
RUN_DIGITS = 3


def row_name(docs: DataFrame) -> Column:
    """Names a row by its id, source and text."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\n", known(docs["doc_id"].cast("string")), known(docs["source"]), text_of(docs)).cast("binary")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and row, which names the row by its id, source and text."""
    words = F.regexp_count(text_of(docs), F.lit(WORD_GAP.replace("[", "[^", 1))).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), row_name(docs).alias("row"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, weight, rank, target: ``share`` of all sizes dealt out by weight, capped at ``most`` times each source.

    What a cap cuts off goes to the others by weight.  With the sources in order of size by weight, the
    capped ones come first: a source is capped where its cap is at most its weight's part of what the ones before leave.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = per.withColumns({"rank": rank, "weight": weight}).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    every = Window.partitionBy(F.lit(0))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", left / heavy)
    free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(free * F.col("weight"), F.col("cap").cast("double")))
    return level.select("source", "source_size", "weight", "rank", target.alias("target"))


def placed(sizes: DataFrame, targets: DataFrame, tilt: float = TILT, most: int = MOST) -> DataFrame:
    """Every document with its copies in the mix: doc_id, source, size, row, source_size, target, positions.

    A source's stream holds its documents by the digest of ``doc_id``, over and over.  A copy is taken if its middle
    lies before the target, and ``positions`` has its training position, from 0 to 1, for each copy taken.
    A prefix sum within runs of equal leading digits is added to one over the runs, so no task gets a whole source.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sizes.select("doc_id", "source", "size", "row", digest.alias("digest")).withColumn("run", F.substring("digest", 1, RUN_DIGITS))
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    by_source = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_size").over(by_source), F.lit(0)))
    plan = runs.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "run", "run_start", "source_size", "rank", "target")
    within = Window.partitionBy("source", "run").orderBy("digest", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    at = rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.run") == F.col("p.run")))
    middle = F.col("p.run_start") + F.col("d.before") + F.col("d.size") / 2
    copies = F.filter(F.array(*[F.lit(k) * F.col("p.source_size") + middle for k in range(most)]), lambda m: m <= F.col("p.target"))
    slope = F.when(F.col("p.rank") % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    return at.select(
        "d.doc_id", "d.source", "d.size", "d.row", "p.source_size", "p.target", F.when(F.col("d.size") > 0, F.transform(copies, lambda m: moment(m / F.col("p.target"), slope))).otherwise(F.array().cast("array<double>")).alias("positions")
    )


def moment(part: Column, slope: Column) -> Column:
    """When a source has had ``part`` of its target, its weight at ``t`` being in proportion to 1 + slope * (2t - 1).

    Demand is the integral, (1 - slope) * t + slope * t * t; this is its inverse.
    """
    low = 1 - slope
    return (2 * part) / (low + F.sqrt(low * low + 4 * slope * part))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, tilt: float = TILT) -> DataFrame:
    """What the mix takes of each row of ``docs(doc_id, text, source)``: doc_id, source, size, row, source_size, target, positions, taken.

    Null texts have size 0, and a document without words is taken no time.  A null source is a source of
    its own, the last.  Rows that share a ``doc_id`` are documents of their own; if they agree in size too, either may come
    first.  Other columns are ignored; an empty table gives none.  Reruns agree, as nothing depends on where rows lie.
    """
    sizes = keep_table(sized(docs), "mix-sizes")
    mix = placed(sizes, source_targets(sizes, weights, share, most), tilt, most)
    return mix.withColumn("taken", F.col("size") * F.size("positions"))


def training_order(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as taken, range-sorted by training position.

    Rows that repeat id, source and text are taken each as often as the mix says.
    """
    mix = mix_sources(docs, **options).filter(F.size("positions") > 0).groupBy("row").agg(F.array_sort(F.collect_list("positions")).alias("mix_turns"))
    named = docs.withColumn("mix_row", row_name(docs))
    met = named.join(mix, F.col("mix_row") == F.col("row")).withColumn("mix_turn", F.row_number().over(Window.partitionBy("mix_row").orderBy(F.lit(0))))
    placed_rows = met.withColumn("mix_position", F.explode(F.get("mix_turns", F.col("mix_turn") - 1)))
    return placed_rows.sort("mix_position", "doc_id").select(*docs.columns, "mix_position")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = lambda k: F.get("positions", F.lit(k)).alias(f"position_{k + 1}")
    mix = mix_sources(docs).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"), at(0), at(1))
    return mix.sort("position_1", "doc_id")


OP5_SQL = r"""
WITH s AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM per),
weighed AS (SELECT *, [5.0, 2.0, 1.0][CAST(rank % 3 + 1 AS INT)]::DOUBLE AS weight, 2 * source_size AS cap FROM ranked),
levels AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
free AS (SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, rank, CAST(least(cap::DOUBLE, coalesce((SELECT level FROM free) * weight, cap::DOUBLE)) AS DOUBLE) AS target FROM levels),
placed AS (SELECT s.*, source_size, target, rank, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
       FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT *, CASE WHEN size > 0 AND middle <= target THEN middle / target END AS part_1, CASE WHEN size > 0 AND source_size + middle <= target THEN (source_size + middle) / target END AS part_2,
                 CASE WHEN rank % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM placed)
SELECT doc_id, size, source_size, target, CAST(size * ((CASE WHEN middle <= target THEN 1 ELSE 0 END) + (CASE WHEN source_size + middle <= target THEN 1 ELSE 0 END)) AS BIGINT) AS taken,
       (2 * part_1) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part_1)) AS position_1, (2 * part_2) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part_2)) AS position_2 FROM parts
"""
