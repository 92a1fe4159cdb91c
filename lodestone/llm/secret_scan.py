"""Secrets in texts: candidates by pattern, and a random forest that tells false findings from true ones.

Everything is columns and SQL functions.  A candidate is a run of key-like characters with a digit, an AWS key id, or whatever
is assigned to a name with a secret word, however short and of whatever characters.  The forest sees its length
and spread of characters, how its characters follow one another, how much of it is dictionary words, whether it is part of a
path, and the words beside it.  The dictionary is the corpus's own: words that several of its documents have.  The forest learns from
labelled findings; by default these are made by rule, from words of that dictionary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import keep_table, text_of

CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9]|(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z]))[A-Za-z0-9+/_\-]{12,}+={0,2}"
#: A name with a secret word, the sign of assignment, and a word for the scheme; then the value, up to its quote, or to a gap, the next name or a tag.
NAMED = r"(?i:(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]*?(?:password|passwd|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private)[A-Za-z0-9_\-]*+[\"']?[ \t]{0,4}(?::=|=>|[=:])[ \t]{0,4}(?:(?:bearer|basic|token)[ \t]+)?)"
GIVEN = r"(?:\"[^\"\n]+(?=\")|'[^'\n]+(?=')|[\"']?(?:(?![&,;][ \t]*[A-Za-z_\-]+[=:]|</?[A-Za-z])[^\s\"'])*(?:(?![&,;][ \t]*[A-Za-z_\-]+[=:]|</?[A-Za-z])[^\s\"',;.)\]}>]))"
ASSIGNED = NAMED + GIVEN
#: Characters beside a candidate that are looked at.
BESIDE = 60
#: Labelled findings that the forest is fitted on at most.
FINDINGS = 6000
#: Documents that a word must be in to be one of the dictionary, and how many of its words findings are made from.
IN_DOCUMENTS, DRAWN = 3, 64
#: What findings are made from where the corpus has no dictionary.
WORDS = "the and for with from this that your test example sample dummy changeme placeholder fake demo user name key token secret value data file image page section chapter order number item index version release build commit report invoice customer product table figure config default production".split()
SECRET_WORDS = r"(?i)(password|passwd|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private)"
PLAIN_WORDS = r"(?i)(example|sample|dummy|placeholder|fake|commit|sha1|sha256|md5|checksum|digest|uuid|guid|order|invoice|number|phone|card|serial|isbn|tracking|revision)"
KINDS = {"aws_access_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$", "hex": r"^[0-9a-fA-F]+$", "digits": r"^[0-9]+$"}
CLASSES = "vcdo"


def findings(docs: DataFrame) -> DataFrame:
    """Candidates of ``docs(doc_id, text)``: doc_id, start (code points before it), value, left and right (what stands beside it).

    Of a run and an assigned value that start at the same place, the longer is the candidate.
    """
    rows = keep_table(docs.select("doc_id", text_of(docs).alias("text")).withColumn("row", F.monotonically_increasing_id()), "secret-texts")
    runs, given = matches(rows, CANDIDATE), matches(rows.filter(F.col("text").rlike(SECRET_WORDS)), ASSIGNED)
    # The name before an assigned value, and its quote, belong to what is left of it.
    name = F.regexp_extract("value", f"^{NAMED}[\"']?", 0)
    value = F.substring(F.col("value"), F.length(name) + 1, F.length("value"))
    given = given.select("row", "doc_id", (F.col("start") + F.length(name)).alias("start"), value.alias("value"), F.right(F.concat("left", name), F.lit(BESIDE)).alias("left"), "right")
    longest = F.row_number().over(Window.partitionBy("row", "start").orderBy(F.desc(F.length("value"))))
    return runs.unionByName(given).withColumn("place", longest).filter("place = 1").drop("row", "place")


def matches(rows: DataFrame, pattern: str) -> DataFrame:
    """What matches in ``rows(row, doc_id, text)``: row, doc_id, start, value, left, right."""
    found = rows.select("row", "doc_id", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("values"), "text").filter(F.size("values") > 0)
    cut = found.select("row", "doc_id", "values", F.split("text", pattern).alias("pieces"))
    each = cut.select("doc_id", "row", "pieces", F.posexplode("values").alias("k", "value")).select("doc_id", "row", "k", "value", F.get("pieces", F.col("k")).alias("before"), F.get("pieces", F.col("k") + 1).alias("after"))
    # A document's candidates in order; what is before one is the pieces and candidates so far.
    so_far = Window.partitionBy("row").orderBy("k")
    start = F.sum(F.length("before")).over(so_far) + F.coalesce(F.sum(F.length("value")).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("row", "doc_id", start.cast("long").alias("start"), "value", F.right("before", F.lit(BESIDE)).alias("left"), F.left("after", F.lit(BESIDE)).alias("right"))


def character_classes() -> Column:
    """The value with a mark for each vowel, other letter, digit and other character."""
    steps = ("[AEIOUaeiou]", "\u0001"), ("[A-Za-z]", "\u0002"), ("[0-9]", "\u0003"), ("[^\u0001-\u0003]", "\u0004")
    return reduce(lambda s, x: F.regexp_replace(s, *x), steps, F.col("value"))


def dictionary(docs: DataFrame, least: int = IN_DOCUMENTS) -> DataFrame:
    """word, documents: the runs of three letters or more, in lower case, that ``least`` documents or more have."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_of(docs)), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("documents")).filter(F.col("documents") >= least)


def drawn_words(words: DataFrame, n: int = DRAWN) -> list[str]:
    """The ``n`` words of four letters or more that most documents have; the list above where there are fewer than ten."""
    found = [r["word"] for r in words.filter(F.length("word") >= 4).orderBy(F.desc("documents"), "word").limit(n).collect()]
    return found if len(found) >= 10 else WORDS


def covered(found: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``found``, named by ``key``, with known: letters of the runs ``found.runs`` (hash and length) that are words of the dictionary."""
    named = words.select(F.xxhash64("word").alias("hash"))
    runs = found.select(*key, F.explode("runs").alias("r")).select(*key, F.col("r.hash").alias("hash"), F.col("r.n").alias("n"))
    hits = runs.join(named, "hash", "left_semi").groupBy(*key).agg(F.sum("n").alias("known"))
    return found.join(hits, key, "left").withColumn("known", F.coalesce("known", F.lit(0)))


def letter_runs() -> Column:
    """Hash and length of each run of three letters or more in the lower value."""
    return F.transform(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.struct(F.xxhash64(w).alias("hash"), F.length(w).alias("n")))


def features() -> dict[str, Column]:
    """The forest's inputs but coverage, from the columns value, left, right and classes."""
    value, left, right = F.col("value"), F.col("left"), F.col("right")
    size = F.length(value).cast("double")
    marks = dict(zip(CLASSES, "\u0001\u0002\u0003\u0004", strict=True))
    part = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    share = lambda ch: (size - F.length(F.replace(value, ch, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda a, ch: a + F.when(ch == "", 0.0).otherwise(-share(ch) * F.log2(share(ch))))
    out = {
        "size": size, "entropy": entropy, "upper": part("[A-Z]"), "lower": part("[a-z]"), "digit": part("[0-9]"), "hex": flag(value.rlike(KINDS["hex"])), "aws": flag(value.rlike(KINDS["aws_access_key"])),
        "slashes": F.regexp_count(value, F.lit("/")).cast("double"), "dashes": F.regexp_count(value, F.lit("[_-]")).cast("double"),
        "in_path": flag(left.rlike(r"(://|/|\\|\.)[^\s\"'=]*$") | right.rlike(r"^(/|\.[A-Za-z0-9]{1,5}\b)")), "assigned": flag(left.rlike(r"[=:]\s*[\"']?$")), "quoted": flag(left.rlike(r"[\"']$") & right.rlike(r"^[\"']")),
        "secret_word": flag(left.rlike(SECRET_WORDS + r"[^\s]{0,12}\s*[=:]?\s*[\"']?$")), "secret_near": flag(left.rlike(SECRET_WORDS)), "plain_word": flag(left.rlike(PLAIN_WORDS) | right.rlike(PLAIN_WORDS) | value.rlike(PLAIN_WORDS)),
    }
    for a in CLASSES:
        for b in CLASSES:
            out[f"{a}_{b}"] = F.regexp_count("classes", F.lit(f"{marks[a]}(?={marks[b]})")) / size
    return out


def labelled_findings(spark: SparkSession, n: int = FINDINGS, words: list[str] = WORDS) -> DataFrame:
    """Findings made by rule, with ``words`` for prose, half of them secrets: value, left, right, label.  The same ones every time."""
    rows = spark.range(n, numPartitions=1).select("id", F.sha2(F.concat(F.lit("a"), "id"), 512).alias("h"), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 256))).alias("b"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("r"))
    hexes = lambda least, most: F.substring("h", F.lit(1), F.lit(least) + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(most - least + 1)).cast("int"))
    upper = F.substring(F.regexp_replace(F.upper("b"), "[^0-9A-Z]", ""), 1, 16)
    digits = F.substring(F.regexp_replace("h", "[^0-9]", ""), 1, 16)
    mixed = F.substring(F.regexp_replace("b", "[^0-9A-Za-z]", ""), 1, 32)
    word = lambda k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int"))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(99)), F.lit(len(xs))) + 1).cast("int"))
    low = F.regexp_replace(F.lower("b"), "[^a-z]", "")
    some_digits = F.substring(digits, F.lit(1), F.lit(1) + F.pmod(F.xxhash64("id", F.lit(6)), F.lit(3)).cast("int"))
    letters = F.substring(F.regexp_replace("b", "[^A-Za-z]", ""), 1, 20)
    syllable = lambda k: pick_at(k, *"cor hor bat sta mon tri vel zin pax lum dra fen gol kip ros tam".split())
    pick_at = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    named = pick_at(98, "password=", "passwd=", "pwd: ", 'password = "', "token=", "secret: ", "api_key = ", "PASSWORD=")
    around = lambda mark: F.concat(word(1), F.lit(" "), word(2), F.lit(mark))
    secret = [
        (F.concat(pick("AKIA", "ASIA"), upper), around(" "), F.concat(F.lit(" "), word(4))),
        (hexes(40, 40), F.concat(around(" "), pick('token = "', 'secret = "', "token: ", "api_key = '", "auth_token=")), F.concat(pick('"', " "), word(4))),
        (hexes(12, 32), F.concat(around(" "), pick("password=", "passwd=", "pwd: ", 'password = "', "PASSWORD=")), F.concat(F.lit(" "), word(4))),
        (mixed, F.concat(around(" "), pick("api_key=", "secret: ", 'access_key = "', "Bearer ", "credential=")), F.concat(F.lit(" "), word(4))),
        (F.concat(syllable(11), syllable(12), F.lit("-"), syllable(13), syllable(14), F.lit("-"), syllable(15), syllable(16)), F.concat(around(" "), named), F.concat(F.lit(" "), word(4))),
        (F.concat(syllable(11), syllable(12), some_digits), F.concat(around(" "), named), F.concat(pick(" ", ", ", "; "), word(4))),
        (F.concat(F.substring(low, F.lit(1), F.lit(3) + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(6)).cast("int")), some_digits), F.concat(around(" "), named), F.concat(F.lit(" "), word(4))),
        (F.concat(F.substring(low, 1, 3), pick("!", "@", "#", "$", "%", "&"), F.substring("h", 1, 3), pick("@", "!", "*", "."), F.substring(low, 4, 3)), F.concat(around(" "), named), F.concat(F.lit(" "), word(4))),
        (letters, F.concat(around(" "), named), F.concat(F.lit(" "), word(4))),
        (F.concat(pick("AKIA", "ASIA"), F.translate(upper, "0123456789", "ABCDEFGHIJ")), around(" "), F.concat(F.lit(" "), word(4))),
    ]
    plain = [
        (digits, around(" "), F.concat(F.lit(" "), word(4))),
        (hexes(40, 64), F.concat(around(" "), pick("commit ", "sha256:", "checksum ", "md5 ", "revision ")), F.concat(F.lit(" "), word(4))),
        (F.concat_ws("-", F.substring("h", 1, 8), F.substring("h", 9, 4), F.substring("h", 13, 4), F.substring("h", 17, 4), F.substring("h", 21, 12)), F.concat(around(" "), pick("id ", "uuid=", "order ", "")), F.concat(F.lit(" "), word(4))),
        (F.concat(word(5), F.lit("_"), word(6), F.lit("_"), F.substring(digits, 1, 2)), around(" "), F.concat(F.lit(" "), word(4))),
        (F.concat(word(5), F.lit("/"), word(6), F.lit("/"), F.substring("h", 1, 12)), F.concat(around(" "), F.lit("https://www.example.com/")), F.concat(pick(".html", "/index", "?page=2"), F.lit(" "))),
        (F.concat(pick("changeme", "placeholder", "example", "dummypassword"), F.substring(digits, 1, 4)), F.concat(around(" "), pick("password=", "token = ", "secret: ")), F.concat(F.lit(" "), word(4))),
        (F.concat(F.lit("AKIA"), F.substring(F.lit("IOSFODNN7EXAMPLE0000"), 1, 16)), F.concat(around(" "), pick("example ", "sample key ", "dummy ")), F.concat(F.lit(" "), word(4))),
        (F.concat(word(5), word(6), word(7), F.substring(digits, 1, 3)), around(" "), F.concat(pick(".", ",", " "), word(4))),
    ]
    # What prose and settings have after a secret word without its being one.
    plain += [(v, F.concat(around(" "), pick("password: ", "token: ", "secret: ", "author: ", "private = ", "auth=")), F.concat(F.lit(" "), word(4))) for v in (word(5), pick("none", "null", "true", "false", "required", "the", "yes", "A", "None", "string", "str", "optional"), F.concat(F.initcap(syllable(11)), syllable(12)), F.concat(F.lit("${"), F.upper(word(5)), F.lit("}")), pick("********", "xxxxxxxx", "<redacted>", "changeme", "..."))]
    kinds = [(1.0, x) for x in secret for _ in range(2)] + [(0.0, x) for x in plain]
    # A plan for each kind: code for all of them at once is too long to be compiled.
    parts = [rows.filter(F.pmod("r", F.lit(len(kinds))) == k).select(F.lit(label).alias("label"), *[c.alias(n) for c, n in zip(x, ("value", "left", "right"), strict=True)]) for k, (label, x) in enumerate(kinds)]
    return reduce(DataFrame.unionByName, parts).filter((F.length("value") >= 12) | F.col("left").rlike(r"[=:]\s*[\"']?$"))


def measured(found: DataFrame) -> DataFrame:
    """The findings with the forest's inputs but coverage, and runs, by which that is looked up; value, left and right are gone."""
    inputs = features()
    return found.withColumn("classes", character_classes()).withColumns({**inputs, "runs": letter_runs()}).drop("classes", "value", "left", "right")


def assembled(rows: DataFrame) -> DataFrame:
    """The rows with ``features``, from the inputs and ``known``."""
    full = rows.withColumn("coverage", F.coalesce(F.try_divide(F.col("known").cast("double"), F.col("size")), F.lit(0.0)))
    inputs = [*features(), "coverage"]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(full).drop("runs", "known", *inputs)


def fit_forest(labelled: DataFrame, words: DataFrame | None = None, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """A forest on at most ``FINDINGS`` labelled findings (value, left, right, label), with the dictionary ``words(word)``."""
    words = words if words is not None else labelled.sparkSession.createDataFrame([(w,) for w in WORDS], "word string")
    first = labelled.orderBy(F.xxhash64("value", "left", "right"), "label").limit(FINDINGS).withColumn("id", F.xxhash64("value", "left", "right"))
    rows = keep_table(assembled(covered(measured(first), words, ["id"])), "secret-labels")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7).fit(rows.select("features", "label"))


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel | None = None, least: float = 0.5) -> DataFrame:
    """A row for each candidate of ``docs(doc_id, text)``: doc_id, start, length, kind, value_sha256, score, is_secret.

    Null and empty texts have none; nor has an empty table.  Rows that repeat are scanned each, null ids are passed
    through, texts of any length are read whole, and other columns are ignored.  The secret itself is neither returned nor kept.
    """
    words = keep_table(dictionary(docs), "secret-words")
    model = model or fit_forest(labelled_findings(docs.sparkSession, words=drawn_words(words)), words)
    kind = reduce(lambda c, k: F.when(F.col("value").rlike(KINDS[k]), F.lit(k)).otherwise(c), ("hex", "digits", "aws_access_key"), F.lit("mixed"))
    found = findings(docs).withColumns({"length": F.length("value").cast("long"), "kind": kind, "value_sha256": F.sha2("value", 256)})
    rows = keep_table(measured(found).withColumn("finding", F.monotonically_increasing_id()), "secret-findings")
    scored = model.transform(assembled(covered(rows, words, ["finding"]))).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return scored.select("doc_id", "start", "length", "kind", "value_sha256", "score", (F.col("score") >= least).alias("is_secret"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
