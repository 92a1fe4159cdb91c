"""The engine: an indexed corpus that answers many queries at once, in three stages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metadata import work_of
from ..functions.text import normal_form, query_form
from ..operators import answers, graph, metrics, models, pairs, scans, search
from ..sources import tables


class Engine:
    """Stage one finds candidates, stage two ranks them, stage three confirms a match.

    ``docs`` has doc_id, text, and optionally source and lang, which stand for work and category.  Nothing is kept in the
    driver; ``fit`` writes the index tables that all queries share to ``folder``, under the corpus's fingerprint, or finds them there.
    """

    def __init__(self, spark: SparkSession, docs: DataFrame, synonyms: dict[str, list[str]] = search.SYNONYMS, model: PipelineModel | None = None, names: DataFrame | None = None, edges: DataFrame | None = None, entity_works: DataFrame | None = None):
        self.spark, self.synonyms, self.model = spark, synonyms, model
        # A search goes through the texts several times; their form is made once.
        self.docs = search.valid(docs).withColumn("text", query_form(F.col("text"))).persist()
        self.raw = docs
        self.names, self.edges, self.entity_works = names, edges, entity_works
        self.index: dict[str, DataFrame] | None = None

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, folder: str | None = None, **options) -> Engine:
        """The engine of a CSV file of passages, with its indexes in ``folder`` if one is given; a passage's number is its place by text and file."""
        rows = tables.read_passages(spark, path).select("text", F.col("source_file").alias("source"), F.col("category").alias("lang"))
        engine = cls(spark, rows.withColumn("doc_id", F.xxhash64("text", "source", "lang")).dropDuplicates(["doc_id"]), **options)
        return engine.fit(folder) if folder else engine

    def fit(self, folder: str) -> Engine:
        """Write the documents and their indexes below ``folder``, once for each corpus: a corpus that has changed has another fingerprint."""
        mark = tables.fingerprint(self.raw).first()["fingerprint"]
        self.docs = tables.cached_table(self.docs, f"{folder}/{mark}", "documents")
        self.index = {name: tables.cached_table(df, f"{folder}/{mark}", name) for name, df in search.index_tables(self.docs).items()}
        return self

    def search(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """query_id, doc_id, score, rank of ``queries(query_id, query)``."""
        asked = queries.withColumn("query", query_form(F.col("query")))
        hits = search.fused_search(self.docs, asked, k, self.synonyms, wide=True, index=self.index)
        if self.names is None:
            return hits
        features = graph.pair_features(hits, asked, self.docs, self.names, self.edges, self.entity_works)
        return graph.rerank(hits, features)

    def retrieve(self, queries: DataFrame, first: int = 100, second: int = 10, third: int = 1) -> DataFrame:
        """The confirmed hits of each query; ranks of a model if there is one, else of stage one."""
        hits = self.search(queries, first).filter(F.col("rank") <= second)
        full = scans.few(hits, queries).join(self.docs.select("doc_id", "text", F.col("source").alias("work"), F.col("lang").alias("category")), "doc_id").join(queries, "query_id")
        if self.model is None:
            scored = models.untrained(full)
        else:
            scored = models.ranked(self.model, pairs.basic_features(full, self.docs), second)
        return pairs.keep_confirmed(pairs.confirmed(scored.drop("rank")), third)

    def ask(self, text: str, shown: int = 10, k: int = 128) -> DataFrame:
        """One question, folded as the users' are: the first hits."""
        one = self.spark.createDataFrame([(0, text)], "query_id long, query string").withColumn("query", normal_form(F.col("query")))
        return self.search(one, k).filter(F.col("rank") <= shown)

    def answer(self, queries: DataFrame, shown: int = 10, k: int = 128, ask: answers.Ask | None = None, rescored: int = 20) -> DataFrame:
        """The first ``shown`` of the ``k`` hits of each query, folded as the users' are, with work, author and category by file name, and counts.

        With a model, the first ``rescored`` get its score and go first.  Columns: query_id, rank, doc_id, text, score, llm_score, work, author, category,
        total_found, total_returned, llm_enhanced.
        """
        asked = queries.select("query_id", normal_form(F.col("query")).alias("query"))
        about = self.docs.select("doc_id", "text", work_of(F.col("source"), F.col("lang")).alias("about")) if "lang" in self.docs.columns else self.docs.select("doc_id", "text", work_of(F.lit(""), F.lit("")).alias("about"))
        hits = scans.few(self.search(asked, k), asked).join(about, "doc_id").join(asked, "query_id")
        hits = answers.by_model_first(answers.scored(hits, ask, most=rescored)) if ask else hits.withColumn("llm_score", F.lit(None).cast("double"))
        counted = hits.withColumn("total_found", F.count("*").over(Window.partitionBy("query_id"))).withColumns({"total_returned": F.least(F.lit(shown), F.col("total_found")), "llm_enhanced": F.lit(ask is not None)})
        return counted.filter(F.col("rank") <= shown).select("query_id", "rank", "doc_id", "text", "score", "llm_score", "about.work", "about.author", "about.category", "total_found", "total_returned", "llm_enhanced")

    def evaluate(self, queries: DataFrame, truth: DataFrame) -> DataFrame:
        return metrics.recall_at(self.search(queries), truth)

    def stats(self) -> DataFrame:
        return self.raw.agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_works"), F.countDistinct("lang").alias("n_categories"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))

    def health(self) -> dict[str, object]:
        return {"status": "ok", "indexed": not self.docs.isEmpty()}
