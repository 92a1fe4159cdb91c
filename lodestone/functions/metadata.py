"""What a file name says of its work: tables of rules, tried in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import whole

# Key in a file name, work, author, category; the first key found counts.
WORKS = [
    ("brndp", "Brahmanda Purana", "Vyasa", "Purana"),
    ("mkp", "Markandeya Purana", "Markandeya", "Purana"),
    ("skp", "Skanda Purana", "Vyasa", "Purana"),
    ("bhp", "Bhagavata Purana", "Vyasa", "Purana"),
    ("vp", "Vishnu Purana", "Parashara", "Purana"),
    ("ap", "Agni Purana", "Agni", "Purana"),
    ("gp", "Garuda Purana", "Vyasa", "Purana"),
    ("pp", "Padma Purana", "Vyasa", "Purana"),
    ("sp", "Shiva Purana", "Vyasa", "Purana"),
    ("mp", "Matsya Purana", "Vyasa", "Purana"),
    ("lp", "Linga Purana", "Vyasa", "Purana"),
    ("kp", "Kurma Purana", "Vyasa", "Purana"),
    ("vamp", "Vamana Purana", "Vyasa", "Purana"),
    ("varp", "Varaha Purana", "Vyasa", "Purana"),
    ("brvp", "Brahmavaivarta Purana", "Vyasa", "Purana"),
    ("bvp", "Bhavishya Purana", "Vyasa", "Purana"),
    ("mbh", "Mahabharata", "Vyasa", "Itihasa"),
    ("ram", "Ramayana", "Valmiki", "Itihasa"),
    ("rv", "Rig Veda", "Various Rishis", "Veda"),
    ("av", "Atharva Veda", "Atharvan", "Veda"),
    ("yv", "Yajur Veda", "Various Rishis", "Veda"),
    ("sv", "Sama Veda", "Various Rishis", "Veda"),
    ("athv", "Atharvaveda Samhita", "Atharvan", "Veda"),
    ("isha", "Isha Upanishad", "Unknown", "Upanishad"),
    ("kena", "Kena Upanishad", "Unknown", "Upanishad"),
    ("katha", "Katha Upanishad", "Unknown", "Upanishad"),
    ("pras", "Prashna Upanishad", "Unknown", "Upanishad"),
    ("mund", "Mundaka Upanishad", "Unknown", "Upanishad"),
    ("mand", "Mandukya Upanishad", "Unknown", "Upanishad"),
    ("ms", "Manusmriti", "Manu", "Dharmashastra"),
    ("ys", "Yajnavalkya Smriti", "Yajnavalkya", "Dharmashastra"),
    ("bhg", "Bhagavad Gita", "Krishna/Vyasa", "Philosophy"),
    ("devi", "Devi Mahatmya", "Markandeya", "Stotra"),
    ("ss", "Surya Siddhanta", "Unknown", "Astronomy"),
    ("ch", "Charaka Samhita", "Charaka", "Ayurveda"),
    ("su", "Sushruta Samhita", "Sushruta", "Ayurveda"),
]
# Further parts of file names, tried next.
PATTERNS = [
    ("rkv", "Rig Veda Khila", "Various Rishis", "Veda"),
    ("narp", "Narada Purana", "Narada", "Purana"),
    ("nsp", "Narasimha Purana", "Unknown", "Purana"),
]
# Citation marks, as written, tried last.
CITATIONS = [
    ("BndP", "Brahmanda Purana", "Vyasa", "Purana"),
    ("MarkP", "Markandeya Purana", "Markandeya", "Purana"),
    ("SkP", "Skanda Purana", "Vyasa", "Purana"),
    ("NarP", "Narada Purana", "Narada", "Purana"),
    ("NsP", "Narasimha Purana", "Unknown", "Purana"),
    ("RKV", "Rig Veda Khila", "Various Rishis", "Veda"),
]
# Parts of a name that hint at a work, in order, and categories by their short names.
HINTS = [("purana", "Purana Text"), ("veda", "Vedic Text"), ("upanishad", "Upanishad"), ("gita", "Bhagavad Gita"), ("ramayana", "Ramayana"), ("ram", "Ramayana"), ("mahabharata", "Mahabharata"), ("mbh", "Mahabharata")]
CATEGORIES = {"1_sanskr": "Sanskrit Text", "purana": "Purana", "veda": "Veda", "upanishad": "Upanishad", "itihasa": "Itihasa", "shastra": "Shastra"}
PLAIN = "1_sanskr"
DEFAULT = "Sanskrit Text"


def category_name(category: Column) -> Column:
    c = whole(category)
    out = F.when((c == "") | (c == PLAIN), DEFAULT)
    for k, v in CATEGORIES.items():
        out = out.when(F.lower(c) == k, v)
    return out.otherwise(F.initcap(c))


def short_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(whole(name)), F.lit(".htm"), F.lit("")), r"\.html|[0-9\-_]", "")


def work_of(name: Column, category: Column) -> Column:
    """work, author and category of a file, as a struct.  A category other than the plain one goes before the rule's own."""
    short, c = short_name(name), whole(category)
    own = (c != "") & (c != PLAIN)
    names = ("key", "work", "author", "category")
    listed = lambda rows: F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r, strict=True)]) for r in rows])
    first = lambda rows, text: F.get(F.filter(listed(rows), lambda r: F.contains(text, r["key"])), F.lit(0))
    by_name, by_mark = first([*WORKS, *PATTERNS], short), first(CITATIONS, whole(name))
    hint = F.get(F.filter(listed([(p, w, "Unknown", DEFAULT) for p, w in HINTS]), lambda r: F.contains(short, r["key"])), F.lit(0))
    item = lambda w, a, k: F.struct(w.alias("work"), a.alias("author"), k.alias("category"))
    return (
        F.when(whole(name) == "", item(F.lit("Unknown"), F.lit("Unknown"), F.when(c != "", c).otherwise(F.lit("Unknown"))))
        .when(by_name.isNotNull(), item(by_name["work"], by_name["author"], F.when(own, category_name(c)).otherwise(by_name["category"])))
        .when(by_mark.isNotNull(), item(by_mark["work"], by_mark["author"], by_mark["category"]))
        .otherwise(item(F.coalesce(hint["work"], F.lit(DEFAULT)), F.lit("Unknown"), F.when(c != "", category_name(c)).otherwise(F.lit(DEFAULT))))
    )
