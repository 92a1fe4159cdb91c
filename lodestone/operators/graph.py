"""Entities in texts, and a graph of entities, works and concepts that re-ranks hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, whole

ETYPES = ["deities", "sages", "places", "concepts", "works"]
# Canonical names and their variants, in order, a table for each type.
DEITIES = {
    "viṣṇu": ["viṣṇu", "viṣṇo", "viṣṇave", "viṣṇor", "hari", "hare", "nārāyaṇa", "keśava", "mādhava", "govinda", "dāmodara", "madhusūdana", "vāsudeva", "kṛṣṇa", "kṛṣṇasya", "murāri", "janārdana"],
    "śiva": ["śiva", "śivasya", "śivāya", "maheśvara", "maheśa", "śaṅkara", "rudra", "īśa", "īśvara", "hara", "bhava", "śambhu", "mahādeva", "tryambaka", "nīlakaṇṭha"],
    "devī": ["devī", "devyā", "ambā", "umā", "pārvatī", "śakti", "bhagavatī", "durgā", "kālī", "lakṣmī", "sarasvatī", "gaurī", "caṇḍī"],
    "brahmā": ["brahmā", "brahmaṇaḥ", "pitāmaha", "svayambhū", "prajāpati", "virañci", "caturmukha", "kamalāsana"],
    "gaṇeśa": ["gaṇeśa", "gaṇapati", "vināyaka", "vighnēśvara", "lambodara", "gajavadana", "heraṃba"],
    "indra": ["indra", "indrasya", "śakra", "vāsava", "purandara", "devarāja", "maghavan", "sahasrākṣa"],
    "agni": ["agni", "agneḥ", "agnaye", "vahni", "anala", "hutāśana", "pāvaka"],
    "sūrya": ["sūrya", "sūryasya", "āditya", "bhāskara", "ravi", "savitṛ", "arka", "mihira", "bhānu"],
    "hanumān": ["hanumān", "hanūmān", "hanumataḥ", "añjaneya", "mārutātmaja", "vāyuputra", "pavana-tanaya"],
    "rāma": ["rāma", "rāmasya", "rāghava", "raghunātha", "dāśarathi", "kausalyeya", "sītāpati", "raghūttama"],
}
SAGES = {
    "vyāsa": ["vyāsa", "vyāsaḥ", "vedavyāsa", "bādarāyaṇa", "kṛṣṇadvaipāyana"],
    "vālmīki": ["vālmīki", "vālmīkeḥ", "ādikavi", "pracetasaḥ"],
    "vasiṣṭha": ["vasiṣṭha", "vasiṣṭhasya", "brahmarṣi"],
    "viśvāmitra": ["viśvāmitra", "viśvāmitrasya", "kauśika", "gādheya"],
    "nārada": ["nārada", "nāradasya", "devarṣi", "nāradamuni"],
    "agastya": ["agastya", "agastyasya", "agastimuni", "kumbhayoni"],
    "bharadvāja": ["bharadvāja", "bharadvājasya"],
    "atri": ["atri", "atreḥ", "atraye"],
    "aṅgiras": ["aṅgiras", "aṅgirasaḥ", "aṅgirā"],
    "gautama": ["gautama", "gautamasya", "gotama"],
    "jamadagni": ["jamadagni", "jamadagneḥ"],
    "kaśyapa": ["kaśyapa", "kaśyapasya"],
    "bhṛgu": ["bhṛgu", "bhṛgoḥ", "bhārgava"],
    "patañjali": ["patañjali", "patañjaleḥ", "yogasūtrakāra"],
    "kālidāsa": ["kālidāsa", "kālidāsasya", "kavikulaguru"],
    "śaṅkara": ["śaṅkara", "śaṅkarācārya", "ādiśaṅkara", "bhagavatpāda"],
}
PLACES = {
    "ayodhyā": ["ayodhyā", "ayodhyāyāṃ", "sāketa"],
    "kāśī": ["kāśī", "kāśyāṃ", "vārāṇasī", "benares"],
    "mathurā": ["mathurā", "mathurāyāṃ", "brajabhūmi"],
    "vṛndāvana": ["vṛndāvana", "vṛndāvane", "vraja", "gokula"],
    "dvārakā": ["dvārakā", "dvārakāyāṃ", "dvāravatī"],
    "hastināpura": ["hastināpura", "hastināpure", "gajasāhvaya"],
    "laṅkā": ["laṅkā", "laṅkāyāṃ", "siṃhala"],
    "kurukṣetra": ["kurukṣetra", "kurukṣetre", "dharmakṣetra"],
    "prayāga": ["prayāga", "prayāge", "triveṇī", "allahabad"],
    "gayā": ["gayā", "gayāyāṃ", "bodhagayā"],
    "himālaya": ["himālaya", "himavat", "himācala", "himādri"],
    "gaṅgā": ["gaṅgā", "gaṅgāyāṃ", "bhāgīrathī", "jāhnavī"],
    "yamunā": ["yamunā", "yamunāyāṃ", "kālindī"],
    "narmadā": ["narmadā", "narmadāyāṃ", "revā"],
    "godāvarī": ["godāvarī", "godāvaryāṃ", "gautamī"],
}
CONCEPT_WORDS = {
    "dharma": ["dharma", "dharmasya", "dharmāya", "dharmāṇi"],
    "karma": ["karma", "karmaṇā", "karmaṇi", "karmaphala"],
    "bhakti": ["bhakti", "bhaktyā", "bhaktimān"],
    "jñāna": ["jñāna", "jñānena", "jñānī"],
    "yoga": ["yoga", "yogena", "yogī", "yogin"],
    "mokṣa": ["mokṣa", "mokṣāya", "mukti", "nirvāṇa", "kaivalya"],
    "saṃsāra": ["saṃsāra", "saṃsāre", "bhavacakra"],
    "brahman": ["brahman", "brahmaṇi", "parabrahma"],
    "ātman": ["ātman", "ātmani", "ātmā"],
    "māyā": ["māyā", "māyayā", "māyāvī"],
    "śānti": ["śānti", "śāntyai", "śāntimān"],
    "ahiṃsā": ["ahiṃsā", "ahiṃsayā"],
    "satya": ["satya", "satyena", "satyavādin"],
    "tapas": ["tapas", "tapasā", "tapasvī"],
    "vairāgya": ["vairāgya", "vairāgyeṇa", "virāga"],
}
WORK_NAMES = {
    "mahābhārata": ["mahābhārata", "mahābhārate", "bhārata"],
    "rāmāyaṇa": ["rāmāyaṇa", "rāmāyaṇe", "ādikāvya"],
    "bhagavadgītā": ["bhagavadgītā", "gītā", "gītāyāṃ"],
    "bhāgavata": ["bhāgavata", "bhāgavate", "śrīmadbhāgavata"],
    "yogasūtra": ["yogasūtra", "pātañjalayogasūtra"],
    "vedānta": ["vedānta", "vedāntasūtra", "brahmasūtra"],
    "manusmṛti": ["manusmṛti", "manusmṛtau", "mānavadharmaśāstra"],
    "arthaśāstra": ["arthaśāstra", "kauṭilīya"],
    "kāmasūtra": ["kāmasūtra", "vātsyāyana"],
    "upaniṣad": ["upaniṣad", "upaniṣat", "vedāntavākya"],
}
LEXICON = dict(zip(ETYPES, (DEITIES, SAGES, PLACES, CONCEPT_WORDS, WORK_NAMES), strict=True))
# Works with their titles and authors.
TITLES = {
    "mahābhārata": ("Mahābhārata", "vyāsa"),
    "rāmāyaṇa": ("Rāmāyaṇa", "vālmīki"),
    "bhagavadgītā": ("Bhagavadgītā", "vyāsa"),
    "bhāgavata": ("Śrīmad Bhāgavata Purāṇa", "vyāsa"),
    "yogasūtra": ("Yoga Sūtra", "patañjali"),
    "manusmṛti": ("Manusmṛti", "manu"),
    "meghadūta": ("Meghadūta", "kālidāsa"),
    "kumārasambhava": ("Kumārasambhava", "kālidāsa"),
    "raghuvaṃśa": ("Raghuvaṃśa", "kālidāsa"),
}
# Relations between entities, in order, and the names of the way back.
RELATIONS = [
    ("kṛṣṇa", "avatar_of", "viṣṇu"),
    ("rāma", "avatar_of", "viṣṇu"),
    ("hanumān", "devotee_of", "rāma"),
    ("arjuna", "disciple_of", "kṛṣṇa"),
    ("pārvatī", "consort_of", "śiva"),
    ("sītā", "consort_of", "rāma"),
    ("rādhā", "beloved_of", "kṛṣṇa"),
    ("lakṣmī", "consort_of", "viṣṇu"),
    ("sarasvatī", "consort_of", "brahmā"),
    ("arjuna", "student_of", "droṇa"),
    ("rāma", "student_of", "vasiṣṭha"),
    ("kṛṣṇa", "student_of", "sāndīpani"),
    ("kṛṣṇa", "born_in", "mathurā"),
    ("kṛṣṇa", "lived_in", "vṛndāvana"),
    ("kṛṣṇa", "ruled", "dvārakā"),
    ("rāma", "born_in", "ayodhyā"),
    ("rāma", "ruled", "ayodhyā"),
    ("vyāsa", "author_of", "mahābhārata"),
    ("vyāsa", "author_of", "bhāgavata"),
    ("vālmīki", "author_of", "rāmāyaṇa"),
    ("kālidāsa", "author_of", "meghadūta"),
    ("kālidāsa", "author_of", "kumārasambhava"),
    ("patañjali", "author_of", "yogasūtra"),
]
INVERSE = {"avatar_of": "has_avatar", "devotee_of": "has_devotee", "disciple_of": "has_disciple", "consort_of": "consort_of", "beloved_of": "beloved_of", "student_of": "teacher_of", "born_in": "birthplace_of", "lived_in": "residence_of", "ruled": "ruled_by", "author_of": "authored_by"}
REPLACING, ADDING = ["avatar_of", "has_avatar", "also_known_as"], ["consort_of", "devotee_of", "student_of"]
# Concepts below a concept.
CONCEPTS = {
    "puruṣārtha": ["dharma", "artha", "kāma", "mokṣa"],
    "yoga": ["jñānayoga", "bhaktiyoga", "karmayoga", "rājayoga"],
    "guṇa": ["sattva", "rajas", "tamas"],
    "varṇa": ["brāhmaṇa", "kṣatriya", "vaiśya", "śūdra"],
    "āśrama": ["brahmacārya", "gṛhastha", "vānaprastha", "sannyāsa"],
    "pramāṇa": ["pratyakṣa", "anumāna", "śabda", "upamāna", "arthāpatti", "anupalabdhi"],
}
# Entities of a work.
ENTITY_WORKS = {
    "mahābhārata": ["kṛṣṇa", "arjuna", "bhīma", "yudhiṣṭhira", "nakula", "sahadeva", "draupadī", "karṇa", "duryodhana", "bhīṣma", "droṇa", "vyāsa"],
    "rāmāyaṇa": ["rāma", "sītā", "lakṣmaṇa", "hanumān", "rāvaṇa", "bharata", "daśaratha", "kauśalyā", "sugrīva", "vālī", "vibhīṣaṇa"],
}
KG_WEIGHTS = {"deities_overlap": 2.0, "sages_overlap": 1.5, "works_overlap": 2.5, "concepts_overlap": 1.0, "places_overlap": 1.0, "related_entity_ratio": 1.5, "work_overlap_ratio": 2.0, "entity_cooccurrence_works": 1.5, "connected_pairs": 1.0}
DEPTH, FAR = 3, 10.0


def lexicon(spark: SparkSession, table: dict[str, dict[str, list[str]]] = LEXICON) -> DataFrame:
    """etype, canon_ord, canonical, variant; a canonical name is a variant of itself."""
    rows = [(t, k, c, v) for t, entries in table.items() for k, (c, vs) in enumerate(entries.items()) for v in dict.fromkeys([c, *vs])]
    return spark.createDataFrame(rows, "etype string, canon_ord int, canonical string, variant string")


def relations(spark: SparkSession, table: list[tuple[str, str, str]] = RELATIONS) -> DataFrame:
    return spark.createDataFrame([(k, *row) for k, row in enumerate(table)], "edge_ord int, src string, rel string, dst string")


def lexicon_of_corpus(docs: DataFrame, per_type: int = 8, least: int = 5) -> DataFrame:
    """A lexicon by rule, for any corpus: the words of most documents, dealt out to types, in pairs of name and variant."""
    words = docs.select(F.explode(F.array_distinct(tokens(F.lower("text")))).alias("w")).filter(F.col("w").rlike(f"^[a-z]{{{least},}}$")).groupBy("w").agg(F.count("*").alias("df"))
    order = Window.orderBy(F.desc("df"), "w")
    ranked = words.orderBy(F.desc("df"), "w").limit(2 * per_type * len(ETYPES)).withColumn("r", F.row_number().over(order) - 1)
    pair = F.floor(F.col("r") / 2).cast("int")
    named = ranked.select(F.element_at(F.array(*map(F.lit, ETYPES)), pair % len(ETYPES) + 1).alias("etype"), F.floor(pair / len(ETYPES)).cast("int").alias("canon_ord"), F.col("w").alias("variant"), (F.col("r") % 2).alias("k"), "r")
    names = named.filter("k = 0").select("etype", "canon_ord", F.col("variant").alias("canonical"))
    return named.join(names, ["etype", "canon_ord"]).select("etype", "canon_ord", "canonical", "variant")


def relations_of_lexicon(names: DataFrame) -> DataFrame:
    """Relations by rule between the names of a lexicon: each to the next one and the one after three, by type and order."""
    ranked = names.select("etype", "canon_ord", "canonical").distinct().withColumn("k", F.row_number().over(Window.orderBy("etype", "canon_ord")) - 1)
    kinds = F.array(*map(F.lit, INVERSE))
    edges = None
    for step in (1, 3):
        a, b = ranked.alias("a"), ranked.alias("b")
        part = a.join(b, F.col("b.k") == F.col("a.k") + step).filter((F.col("a.k") + step) % 4 != 0).select(
            (F.col("a.k") * 10 + step).cast("int").alias("edge_ord"), F.col("a.canonical").alias("src"), F.element_at(kinds, (F.col("a.k") + step) % len(INVERSE) + 1).alias("rel"), F.col("b.canonical").alias("dst")
        )
        edges = part if edges is None else edges.unionByName(part)
    return edges


def with_inverse(edges: DataFrame, inverse: dict[str, str] = INVERSE) -> DataFrame:
    """Every relation and its way back; of equal ones the first."""
    table = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
    back = edges.select("edge_ord", F.col("dst").alias("src"), table[F.col("rel")].alias("rel"), F.col("src").alias("dst")).filter("rel IS NOT NULL")
    return edges.select("edge_ord", "src", "rel", "dst").unionByName(back).groupBy("src", "rel", "dst").agg(F.min("edge_ord").alias("edge_ord"))


def neighbours(edges: DataFrame, of: DataFrame, rel: str | None = None) -> DataFrame:
    """Neighbours of ``of(entity)``, in the order in which they were declared."""
    found = of.join(edges if rel is None else edges.filter(F.col("rel") == rel), F.col("entity") == F.col("src"))
    order = Window.partitionBy("entity").orderBy("edge_ord", "dst", "rel")
    return found.select("entity", "rel", F.col("dst").alias("neighbour"), F.row_number().over(order).alias("ord"))


def paths(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """a, b, hops: the shortest way of at most ``depth`` relations between every two entities; 0 to itself."""
    step = edges.select("src", "dst").distinct()
    nodes = step.select("src").union(step.select("dst")).distinct()
    reach = nodes.select(F.col("src").alias("a"), F.col("src").alias("b"), F.lit(0).alias("hops"))
    front = reach
    for k in range(1, depth + 1):
        front = front.join(step, F.col("b") == F.col("src")).select("a", F.col("dst").alias("b"), F.lit(k).alias("hops")).distinct()
        reach = reach.unionByName(front)
    return reach.groupBy("a", "b").agg(F.min("hops").alias("hops"))


def descendants(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """ancestor, concept, depth for ``pairs(parent, child)``, by a recursive query."""
    return spark.sql(
        """
        WITH RECURSIVE below(ancestor, concept, depth) AS (
            SELECT parent, child, 1 FROM {pairs} UNION ALL
            SELECT ancestor, p.child, depth + 1 FROM below JOIN {pairs} p ON p.parent = below.concept WHERE depth < 20)
        SELECT ancestor, concept, min(depth) AS depth FROM below GROUP BY ancestor, concept""",
        pairs=pairs,
    )


def common_works(entity_works: DataFrame, wanted: DataFrame) -> DataFrame:
    """group_id, work: the works that have all entities of ``wanted(group_id, entity)``; entities without any work count too."""
    need = wanted.distinct().groupBy("group_id").agg(F.count("*").alias("need"))
    has = wanted.distinct().join(entity_works.select("entity", "work").distinct(), "entity").groupBy("group_id", "work").agg(F.count("*").alias("has"))
    return has.join(need, "group_id").filter("has = need").select("group_id", "work")


def works_of(spark: SparkSession, table: dict[str, list[str]] = ENTITY_WORKS) -> DataFrame:
    """entity, work."""
    return spark.createDataFrame([(e, w) for w, es in table.items() for e in es], "entity string, work string")


def titles_of(spark: SparkSession, table: dict[str, tuple[str, str]] = TITLES) -> DataFrame:
    """work, title, author."""
    return spark.createDataFrame([(w, *about) for w, about in table.items()], "work string, title string, author string")


def concepts_of(spark: SparkSession, table: dict[str, list[str]] = CONCEPTS) -> DataFrame:
    """parent, child."""
    return spark.createDataFrame([(p, c) for p, cs in table.items() for c in cs], "parent string, child string")


def entity_context(of: DataFrame, edges: DataFrame, entity_works: DataFrame, titles: DataFrame, concepts: DataFrame) -> DataFrame:
    """A report for each of ``of(entity)``: its relations in their order, its works, what is known of these, and the concepts below it; empty lists where there is nothing."""
    one = lambda df, column, name: df.groupBy("entity").agg(F.array_sort(F.collect_list(column)).alias(name))
    wanted = of.select("entity").distinct()
    relations_in_order = one(neighbours(edges, wanted), F.struct("ord", "rel", "neighbour"), "relations")
    works = entity_works.select("entity", "work").distinct().join(wanted, "entity", "left_semi")
    details = works.join(titles, "work").select("entity", F.struct("work", "title", "author").alias("d"))
    below = concepts.select(F.col("parent").alias("entity"), "child")
    out = wanted
    for part in (relations_in_order, one(works, F.col("work"), "works"), one(details, F.col("d"), "work_details"), one(below, F.col("child"), "related_concepts")):
        out = out.join(part, "entity", "left")
    kinds = {"relations": "array<struct<ord:int,rel:string,neighbour:string>>", "works": "array<string>", "work_details": "array<struct<work:string,title:string,author:string>>", "related_concepts": "array<string>"}
    return out.select("entity", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in kinds.items()])


def save_graph(folder: str, **tables: DataFrame) -> None:
    """Write the tables of a graph, such as names, edges and works, each as JSON lines in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def load_graph(spark: SparkSession, folder: str, **schemas: str) -> dict[str, DataFrame]:
    """The tables that ``save_graph`` wrote, by name, each with the schema that is given for it."""
    return {name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


# Entities


WORD, GAP = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"


#: Rows of a table that goes to all tasks.
SMALL = 20_000


def sent(rows: DataFrame, bounded_by: DataFrame) -> DataFrame:
    """``rows``, no more than ``bounded_by`` has, for all tasks if these are few."""
    return F.broadcast(rows) if bounded_by.limit(SMALL + 1).count() <= SMALL else rows


def mentions(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = 2) -> DataFrame:
    """key, etype, canonical, matched, at for every variant in a text, letters' case aside; the first canonical name that has it counts.

    Words, and runs of up to ``most_words`` words with what stands between them, meet the lexicon in a join, so a lexicon may have any size; one of up to
    ``SMALL`` rows goes to all tasks, and no word is shuffled to meet it; ``at`` is the
    number of the first word.  Of variants of a type that overlap, the one that starts first counts, then the longest.
    """
    pieces = F.regexp_extract_all(whole(F.col(text)), F.lit(f"({WORD}|{GAP})"), F.lit(1))
    cut = docs.select(key, pieces.alias("pieces")).filter(F.size("pieces") > 0).withColumn("lead", F.when(F.get("pieces", F.lit(0)).rlike(f"^{WORD}"), 0).otherwise(1))
    cut = cut.withColumn("n", F.floor((F.size("pieces") - F.col("lead") + 1) / 2).cast("int"))
    none = F.array().cast("array<struct<at:int,words:int,matched:string>>")

    def run(k: int) -> Column:
        one = lambda i: F.struct(i.alias("at"), F.lit(k).alias("words"), F.lower(F.array_join(F.slice("pieces", 2 * i + F.col("lead") + 1, 2 * k - 1), "")).alias("matched"))
        return F.coalesce(F.when(F.col("n") >= k, F.transform(F.sequence(F.lit(0), F.col("n") - k), one)), none)

    words = cut.select(key, F.explode(F.concat(*[run(k) for k in range(1, most_words + 1)])).alias("w")).select(key, "w.at", "w.words", "w.matched")
    first = names.groupBy("etype", F.lower("variant").alias("variant")).agg(F.min_by("canonical", "canon_ord").alias("canonical"))
    found = words.join(sent(first, names), F.col("matched") == F.col("variant")).select(key, "etype", "canonical", "matched", "at", "words")
    # In order of place, the longest first; one that starts inside the one taken before goes.
    of_type = found.groupBy(key, "etype").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("words")).alias("less"), "words", "canonical", "matched"))).alias("all"))
    kind = "struct<next:int,taken:array<struct<at:int,less:int,words:int,canonical:string,matched:string>>>"
    begin = F.struct(F.lit(0).alias("next"), F.array().alias("taken")).cast(kind)
    step = lambda acc, m: F.when(m["at"] >= acc["next"], F.struct((m["at"] + m["words"]).alias("next"), F.concat(acc["taken"], F.array(m)).alias("taken")).cast(kind)).otherwise(acc)
    alone = F.forall("all", lambda m: m["words"] == 1)
    taken = F.when(alone, F.col("all")).otherwise(F.aggregate("all", begin, step)["taken"])
    return of_type.select(key, "etype", F.explode(taken).alias("m")).select(key, "etype", "m.canonical", "m.matched", "m.at")


def with_offsets(found: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Mentions with start and end, in characters of the text; only texts with a mention are cut again."""
    places = found.groupBy(key).agg(F.collect_list(F.struct("etype", "canonical", "matched", "at")).alias("ms"))
    pieces = F.regexp_extract_all(whole(F.col(text)), F.lit(f"({WORD}|{GAP})"), F.lit(1))
    cut = places.join(docs.select(key, pieces.alias("pieces")), key).withColumn("lead", F.when(F.get("pieces", F.lit(0)).rlike(f"^{WORD}"), 0).otherwise(1))
    each = cut.select(key, "lead", "pieces", F.explode("ms").alias("m"))
    start = F.length(F.array_join(F.slice("pieces", F.lit(1), 2 * F.col("m.at") + F.col("lead")), ""))
    return each.select(key, "m.etype", "m.canonical", "m.matched", "m.at", start.alias("start"), (start + F.length("m.matched")).alias("end"))


def entity_features(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, different names and densities by type for every document, those without a mention too."""
    found = mentions(docs, names, key, text)
    one = lambda t: F.when(F.col("etype") == t, F.col("canonical"))
    counted = found.groupBy(key).agg(*[F.count(one(t)).alias(f"{t}_count") for t in ETYPES], F.count("*").alias("total"), *[F.countDistinct(one(t)).alias(f"unique_{t}") for t in ETYPES])
    sized = docs.select(key, F.size(tokens(F.col(text))).alias("words")).join(counted, key, "left").na.fill(0)
    part = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("words")), F.lit(0.0)), 9)
    density = [part("total").alias("entity_density"), part("deities_count").alias("deity_density"), part("concepts_count").alias("concept_density")]
    return sized.select(key, *[f"{t}_count" for t in ETYPES], "total", *[f"unique_{t}" for t in ETYPES], *density)


def expand_by_graph(queries: DataFrame, names: DataFrame, edges: DataFrame, entity_works: DataFrame | None = None, titles: DataFrame | None = None, most: int = 5) -> DataFrame:
    """query_id, variant: the query, and for the first ``most`` neighbours of each entity in it, its name in the entity's place or after the query.

    With ``entity_works(entity, work)`` and ``titles(work, title)``, also the query with the title of the first ``most`` works that have all its deities and sages.
    """
    seen = mentions(queries, names, "query_id", "query")
    found = seen.select("query_id", F.col("canonical").alias("entity"), "matched").distinct()
    near = neighbours(edges, found.select("entity").distinct()).filter(F.col("ord") <= most)
    rows = found.join(near, "entity").join(queries, "query_id")
    low = F.lower("query")
    variant = F.when(F.col("rel").isin(REPLACING), F.replace(low, F.col("matched"), F.col("neighbour"))).when(F.col("rel").isin(ADDING), F.concat_ws(" ", low, "neighbour"))
    out = queries.select("query_id", F.col("query").alias("variant")).unionByName(rows.select("query_id", variant.alias("variant")).filter("variant IS NOT NULL"))
    if entity_works is not None and titles is not None:
        common = common_works(entity_works, seen.filter(F.col("etype").isin("deities", "sages")).select(F.col("query_id").alias("group_id"), F.col("canonical").alias("entity")))
        named = common.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("work"))).filter(F.col("k") <= most).join(titles.select("work", "title"), "work")
        out = out.unionByName(named.join(queries, F.col("group_id") == F.col("query_id")).select("query_id", F.concat_ws(" ", low, "title").alias("variant")))
    return out.distinct()


def entity_sets(docs: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """key with a sorted set of names for each type, and of all."""
    found = mentions(docs, names, key, text)
    sets = found.groupBy(key).agg(*[F.array_sort(F.collect_set(F.when(F.col("etype") == t, F.col("canonical")))).alias(t) for t in ETYPES], F.array_sort(F.collect_set("canonical")).alias("every"))
    none = F.array().cast("array<string>")
    return docs.select(key).join(sets, key, "left").select(key, *[F.coalesce(c, none).alias(c) for c in [*ETYPES, "every"]])


def pair_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, names: DataFrame, edges: DataFrame, entity_works: DataFrame) -> DataFrame:
    """The graph's features of each pair of query and document, and kg_score, their weighted mean, at most 1.

    Entities and their neighbours are sets in columns; ways between the first five entities of either side come from
    the table of all short ways, which depends on the graph alone.  The graph, the sets and the pairs with their sets are kept, as
    several parts read each: in one plan their sorts and aggregates would all hold memory of one task.
    """
    edges, entity_works, pairs = edges.persist(), entity_works.persist(), pairs.persist()
    named = lambda side, c: f"{side}_works_named" if c == "works" else f"{side}_{c}"
    q = entity_sets(queries, names, "query_id", "query").select("query_id", *[F.col(c).alias(named("q", c)) for c in [*ETYPES, "every"]]).persist()
    d = entity_sets(docs.join(sent(pairs.select("doc_id").distinct(), pairs), "doc_id", "left_semi"), names, "doc_id", "text").select("doc_id", *[F.col(c).alias(named("d", c)) for c in [*ETYPES, "every"]]).persist()
    none = F.array().cast("array<string>")
    near = edges.groupBy(F.col("src").alias("e")).agg(F.collect_set("dst").alias("near"))
    works = entity_works.groupBy(F.col("entity").alias("e")).agg(F.collect_set("work").alias("works"))

    def gathered(side: DataFrame, key: str, every: str, table: DataFrame, column: str, name: str) -> DataFrame:
        found = side.select(key, F.explode(every).alias("e")).join(table, "e").groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(column)))).alias(name))
        return side.join(found, key, "left").withColumn(name, F.coalesce(name, none))

    q = gathered(q, "query_id", "q_every", works, "works", "q_works").withColumn("q_works", F.array_union("q_works", F.col("q_works_named")))
    q = q.join(q.select("query_id", F.explode("q_every").alias("e")).join(near, "e").groupBy("query_id").agg(F.flatten(F.collect_list("near")).alias("q_near")), "query_id", "left").withColumn("q_near", F.coalesce("q_near", none))
    d = gathered(d, "doc_id", "d_every", works, "works", "d_works").withColumn("d_works", F.array_union("d_works", F.col("d_works_named")))
    rows = pairs.select("query_id", "doc_id").join(q.persist(), "query_id").join(d.persist(), "doc_id").persist()
    ways = paths(edges).persist()
    firsts = rows.select("query_id", "doc_id", F.explode(F.slice("q_every", 1, 5)).alias("a"), F.slice("d_every", 1, 5).alias("ds")).select("query_id", "doc_id", "a", F.explode("ds").alias("b"))
    linked = firsts.join(ways, ["a", "b"], "left").withColumn("hops", F.coalesce("hops", F.when(F.col("a") == F.col("b"), 0)))
    ways_of = linked.groupBy("query_id", "doc_id").agg(F.min("hops").alias("least"), F.avg("hops").alias("mean"), F.count("hops").alias("connected"))
    asked_for = rows.filter((F.size("q_every") > 0) & (F.size("d_every") > 0)).select(F.struct("query_id", "doc_id").alias("group_id"), F.explode(F.array_union("q_every", "d_every")).alias("entity"))
    together = common_works(entity_works, asked_for).groupBy("group_id").agg(F.count("*").alias("together")).select("group_id.*", "together")
    rows = rows.join(ways_of, ["query_id", "doc_id"], "left").join(together, ["query_id", "doc_id"], "left")
    size = lambda c: F.size(c).cast("double")
    out = {}
    for t in ETYPES:
        common, union = F.array_intersect(named("q", t), named("d", t)), F.array_union(named("q", t), named("d", t))
        out[f"{t}_overlap"] = size(common)
        out[f"{t}_jaccard"] = F.round(F.coalesce(F.try_divide(size(common), size(union)), F.lit(0.0)), 9)
    # Neighbours count once for each of the query's entities.
    related = F.size(F.filter("q_near", lambda e: F.array_contains("d_every", e))).cast("double")
    out["related_entity_overlap"] = related
    out["related_entity_ratio"] = F.round(related / F.greatest(size("q_near"), F.lit(1.0)), 9)
    both = size(F.array_intersect("q_works", "d_works"))
    out["common_works"] = both
    out["work_overlap_ratio"] = F.round(both / F.greatest(size(F.array_union("q_works", "d_works")), F.lit(1.0)), 9)
    out["entity_cooccurrence_works"] = F.coalesce("together", F.lit(0)).cast("double")
    out["min_path_length"] = F.coalesce(F.col("least").cast("double"), F.lit(FAR))
    out["avg_path_length"] = F.round(F.coalesce("mean", F.lit(FAR)), 9)
    out["connected_pairs"] = F.coalesce(F.col("connected").cast("double"), F.lit(0.0))
    made = rows.select("query_id", "doc_id", "q_every", "q_works", *[c.alias(n) for n, c in out.items()])
    total = sum(KG_WEIGHTS.values())
    score = sum((F.col(n) * w for n, w in KG_WEIGHTS.items()), F.lit(0.0)) / total
    return made.withColumn("kg_score", F.round(F.least(F.lit(1.0), score), 9))


def rerank(hits: DataFrame, features: DataFrame) -> DataFrame:
    """Hits in order of 0.7 of their score and 0.3 of the graph's; the score stays."""
    joined = hits.join(features.select("query_id", "doc_id", "kg_score"), ["query_id", "doc_id"]).withColumn("combined_score", F.round(0.7 * F.col("score") + 0.3 * F.col("kg_score"), 6))
    return joined.withColumn("kg_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "doc_id")))


def consistency(features: DataFrame, work_entities: DataFrame | None = None) -> DataFrame:
    """The features with consistency: the mean of the signs there are that query and document fit.

    Signs are the part of the query's entities that the document's work has, where ``work_entities(doc_id, expected)`` names them,
    related entities, shared works, and short ways.
    """
    rows = features.join(work_entities, "doc_id", "left") if work_entities is not None else features.withColumn("expected", F.lit(None).cast("array<string>"))
    fits = F.when((F.size("q_every") > 0) & (F.size("expected") > 0), F.size(F.array_intersect("q_every", "expected")) / F.size("q_every"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    signs = F.filter(F.array(fits, positive("related_entity_ratio"), positive("work_overlap_ratio"), F.when(F.col("min_path_length") < FAR, 1 / (1 + F.col("min_path_length")))), lambda x: x.isNotNull())
    mean = F.when(F.size(signs) > 0, F.aggregate(signs, F.lit(0.0), lambda a, x: a + x) / F.size(signs)).otherwise(0.0)
    return rows.withColumn("consistency", F.round(mean, 6))
