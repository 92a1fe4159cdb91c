"""Text as columns: words, normal forms, scripts, compounds, citations.

Every function takes and returns columns, so it stays in the plan; only NFC, which Spark lacks, needs Arrow.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GAP = r"[\x20\x09-\x0D]+"

# Folds of letters, and the marks that go.
FOLD_FROM, FOLD_TO = "āīūṛṝḷḹēōṃḥṅñṭḍṇśṣ", "aiurrlleomhnntdnss"
ACCENT_FROM, ACCENT_TO = "áàéèíìóòúù", "aaeeiioouu"
MARKS = "॒᳜॑᳚᳛"
# Variants of query terms.
VARIANTS = {
    "dharma": ["dharma", "dharm", "righteous", "duty"],
    "karma": ["karma", "karm", "action", "deed"],
    "moksha": ["moksha", "moksa", "liberation", "release"],
    "artha": ["artha", "wealth", "purpose", "meaning"],
    "kama": ["kama", "desire", "pleasure", "love"],
}
# First and last parts at which a compound is cut, in order.
PREFIXES = ["pra", "upa", "anu", "apa", "ava", "adhi", "abhi", "sam", "pari"]
SUFFIXES = ["bhāva", "tva", "tā", "maya", "vat", "mat"]
# Word ends that tell the language, each up to a word border.
TELLING = ["atha", "eva", "ca", "tu", "hi", "iti", "yat", "tad", "sarvam?"]
# Endings in Devanagari, of a lemma, of a verb and of a noun.
LEMMA_ENDS = ["ति", "ते", "न्ति", "न्ते", "अः", "आः", "अम्", "आन्"]
VERB_ENDS = ["ति", "ते", "न्ति", "न्ते"]
NOUN_ENDS = ["अः", "आः", "अम्", "आन्", "एन"]
CONJUNCTIONS = ["च", "वा", "अथवा", "किन्तु"]


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it, in functions over its elements too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    """Gaps become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, GAP, " "))


def tokens(text: Column) -> Column:
    """Runs of characters between gaps; a null text has none."""
    return F.array_remove(F.split(whole(text), GAP), "")


@F.pandas_udf(StringType())
def to_nfc(texts: pd.Series) -> pd.Series:
    from unicodedata import normalize

    return texts.map(lambda x: None if x is None else normalize("NFC", x))


def in_nfc(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` in NFC.  Only rows with a combining mark or another letter that NFC may change leave the JVM."""
    may_change = whole(F.col(column)).rlike(r"[\p{M}\x{1100}-\x{11FF}\x{2000}-\x{2FFF}\x{F900}-\x{FAFF}\x{1F71}\x{1FEF}\x{0340}-\x{0387}]")
    return df.filter(~may_change).unionByName(df.filter(may_change).withColumn(column, to_nfc(column)))


def fold(text: Column) -> Column:
    """Letters with diacritics as plain ones."""
    return F.translate(text, FOLD_FROM, FOLD_TO)


def normal_form(text: Column) -> Column:
    """Lower case without accents, marks and diacritics, single spaces; give the text in NFC."""
    return squeeze(F.translate(F.lower(whole(text)), ACCENT_FROM + FOLD_FROM + MARKS, ACCENT_TO + FOLD_TO))


def cleaned(text: Column) -> Column:
    """Gaps closed, then digits, dandas, tags and entities gone, in that order."""
    steps = [(GAP, " "), ("[0-9]+", ""), ("[।॥]+", " "), ("<[^>]+>", ""), ("&[a-zA-Z]+;", "")]
    return F.btrim(reduce(lambda t, s: F.regexp_replace(t, *s), steps, whole(text)), F.lit(" \t\n\x0b\x0c\r"))


def query_form(text: Column) -> Column:
    """What an index of passages holds of a text: no dandas, digits and brackets."""
    steps = [("[।॥]+", " "), ("[0-9]+", ""), (r"[/\[\](){}]+", " ")]
    return squeeze(reduce(lambda t, s: F.regexp_replace(t, *s), steps, whole(text)))


def ascii_form(text: Column) -> Column:
    return F.lower(F.regexp_replace(fold(whole(text)), r"[^\x00-\x7F]", ""))


def script(text: Column) -> Column:
    """devanagari, iast, hk, itrans, slp1 or unknown: the first whose letters are frequent enough."""
    t = whole(text)
    n = F.length(t)
    count = lambda p: F.regexp_count(t, F.lit(p))
    return (
        F.when(count("[\\x{0900}-\\x{097F}]") > n * 0.1, "devanagari")
        .when(count(f"[{FOLD_FROM}]") > 2, "iast")
        .when((count("[AEIOURLM~H]") > n * 0.1) & (t == F.upper(t)) & (t != F.lower(t)), "hk")
        .when(t.rlike(r"[~\^]"), "itrans")
        .when(F.lower(t).rlike("[xyz]"), "slp1")
        .otherwise("unknown")
    )


def is_telling(text: Column, words=TELLING) -> Column:
    """Whether a text seems to be in the corpus language: by script, by diacritics, or by two telling word ends."""
    t, low = whole(text), F.lower(whole(text))
    hits = reduce(lambda a, b: a + b, [low.rlike(f"{w}(?![\\p{{L}}\\p{{N}}_])").cast("int") for w in words])
    return (F.regexp_count(t, F.lit("[\\x{0900}-\\x{097F}]")) > F.length(t) * 0.1) | (F.regexp_count(low, F.lit(f"[{FOLD_FROM}]")) > 3) | (hits > 1)


def compound_parts(word: Column, prefixes=PREFIXES, suffixes=SUFFIXES, least: int = 6) -> Column:
    """A word of ``least`` letters or more cut after the first prefix or else before the first suffix that it has."""
    n = F.length(word)
    out = F.when(n < least, F.array(word))
    for p in prefixes:
        out = out.when(word.startswith(p) & (n > len(p) + 2), F.array(F.lit(p), F.substring(word, len(p) + 1, 1 << 30)))
    for s in suffixes:
        out = out.when(word.endswith(s) & (n > len(s) + 2), F.array(F.substring(word, F.lit(1), n - len(s)), F.lit(s)))
    return out.otherwise(F.array(word))


def split_compounds(text: Column, prefixes=PREFIXES, suffixes=SUFFIXES) -> Column:
    return F.flatten(F.transform(tokens(text), lambda w: compound_parts(w, prefixes, suffixes)))


def lemma(word: Column, ends=LEMMA_ENDS) -> Column:
    out = F.when(F.lit(False), word)
    for e in ends:
        out = out.when(word.endswith(e), F.substring(word, F.lit(1), F.length(word) - len(e)))
    return out.otherwise(word)


def part_of_speech(word: Column) -> Column:
    """Noun endings go before verb endings; conjunctions are listed."""
    ends = lambda xs: reduce(lambda a, b: a | b, [word.endswith(x) for x in xs])
    return F.when(ends(NOUN_ENDS), "noun").when(ends(VERB_ENDS), "verb").when(word.isin(CONJUNCTIONS), "conj").otherwise("unknown")


def variants(text: Column, table: dict[str, list[str]] = VARIANTS) -> Column:
    """The lower form, the folded form, and the variants of every key that the lower form contains; each once."""
    low = F.lower(whole(text))
    parts = [F.when(F.contains(low, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in table.items()]
    return F.array_distinct(F.concat(F.array(low, fold(low)), *parts))


def citation(text: Column) -> dict[str, Column]:
    """What stands between double slashes, its abbreviation and number, and the first chapter and verse."""
    t = whole(text)
    some = lambda c: F.nullif(c, F.lit(""))
    inner = some(F.regexp_extract(t, "//([^/]+)//", 1))
    return {
        "citation": inner,
        "abbreviation": some(F.regexp_extract(inner, r"([A-Za-z]+P?)_?(\d+)?", 1)),
        "chapter": some(F.regexp_extract(t, r"(\d+)\.(\d+)", 1)),
        "verse": some(F.regexp_extract(t, r"(\d+)\.(\d+)", 2)),
    }


def length_buckets(text: Column) -> dict[str, Column]:
    n = F.length(whole(text))
    step = lambda c, k: (F.floor(c / k) * k).cast("long")
    return {"chars_50": step(n, 50), "words_5": step(F.size(tokens(text)), 5), "chars_100": step(n, 100)}


DEVANAGARI_VOWELS = dict(zip("अआइईउऊऋॠऌएऐओऔ", ["a", "ā", "i", "ī", "u", "ū", "ṛ", "ṝ", "ḷ", "e", "ai", "o", "au"], strict=True))
DEVANAGARI_SIGNS = dict(zip("ािीुूृॄॢेैोौ", ["ā", "i", "ī", "u", "ū", "ṛ", "ṝ", "ḷ", "e", "ai", "o", "au"], strict=True))
DEVANAGARI_CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(), strict=True))
DEVANAGARI_MARKS = dict(zip("ंःँऽ।॥०१२३४५६७८९", ["ṃ", "ḥ", "m̐", "'", "|", "||", *"0123456789"], strict=True))
HARVARD_KYOTO = {"lRR": "ḹ", "lR": "ḷ", "RR": "ṝ", "A": "ā", "I": "ī", "U": "ū", "R": "ṛ", "M": "ṃ", "H": "ḥ", "G": "ṅ", "J": "ñ", "T": "ṭ", "D": "ḍ", "N": "ṇ", "z": "ś", "S": "ṣ"}
SLP1 = {"A": "ā", "I": "ī", "U": "ū", "f": "ṛ", "F": "ṝ", "x": "ḷ", "X": "ḹ", "E": "ai", "O": "au", "M": "ṃ", "H": "ḥ", "K": "kh", "G": "gh", "N": "ṅ", "C": "ch", "J": "jh", "Y": "ñ", "w": "ṭ", "W": "ṭh", "q": "ḍ", "Q": "ḍh", "R": "ṇ", "T": "th", "D": "dh", "P": "ph", "B": "bh", "S": "ś", "z": "ṣ"}
ITRANS = {"aa": "ā", "ii": "ī", "uu": "ū", "RRi": "ṛ", "RRI": "ṝ", "A": "ā", "I": "ī", "U": "ū", "M": "ṃ", "H": "ḥ", "~N": "ṅ", "~n": "ñ", "Th": "ṭh", "T": "ṭ", "Dh": "ḍh", "D": "ḍ", "N": "ṇ", "Sh": "ṣ", "shh": "ṣ", "sh": "ś", "Ch": "ch", "ch": "c"}


def by_table(table: dict[str, str]):
    """Texts with the keys of ``table`` replaced, of those at a place the longest: first those of several characters by a pattern, then single ones."""
    several = sorted((k for k in table if len(k) > 1), key=len, reverse=True)
    single = str.maketrans({k: v for k, v in table.items() if len(k) == 1})
    if not several:
        return lambda text: text.translate(single)
    # What takes the place of several characters is cut out of the text before single ones are replaced.
    pattern = re.compile("(" + "|".join(map(re.escape, several)) + ")")

    def turned(text: str) -> str:
        parts = pattern.split(text)
        parts[::2] = [x.translate(single) for x in parts[::2]]
        parts[1::2] = [table[x] for x in parts[1::2]]
        return "".join(parts)

    return turned


TURNED = {"hk": by_table(HARVARD_KYOTO), "itrans": by_table(ITRANS), "slp1": by_table(SLP1)}
# A consonant carries an a, unless a vowel sign or the stop mark follows.
BARE = re.compile("([" + "".join(DEVANAGARI_CONSONANTS) + "])(?![" + "".join(DEVANAGARI_SIGNS) + "्])")
FROM_DEVANAGARI = str.maketrans(DEVANAGARI_CONSONANTS | DEVANAGARI_MARKS | DEVANAGARI_SIGNS | DEVANAGARI_VOWELS | {"्": ""})


def to_iast(text: str | None, kind: str) -> str:
    """One text from Devanagari, Harvard-Kyoto, ITRANS or SLP1 to Roman letters with diacritics."""
    if not text:
        return ""
    if kind == "devanagari":
        return BARE.sub(r"\1a", text).translate(FROM_DEVANAGARI)
    return TURNED[kind](text) if kind in TURNED else text


VOWEL_OF, SIGN_OF, CONSONANT_OF = ({v: k for k, v in t.items()} for t in (DEVANAGARI_VOWELS, DEVANAGARI_SIGNS, DEVANAGARI_CONSONANTS))
MARK_OF = {"ṃ": "ं", "ḥ": "ः", "'": "ऽ"}
either = lambda *tables: "|".join(sorted((x for t in tables for x in t), key=len, reverse=True))
#: A consonant with the vowel after it, if there is one, or else a vowel, or another mark.
SYLLABLE = re.compile(f"({either(CONSONANT_OF)})({either(VOWEL_OF)})?|({either(VOWEL_OF)})|([{''.join(MARK_OF)}])")


def syllable(m: re.Match) -> str:
    consonant, vowel, alone, mark = m.groups()
    if consonant:
        return CONSONANT_OF[consonant] + ("्" if vowel is None else "" if vowel == "a" else SIGN_OF[vowel])
    return VOWEL_OF[alone] if alone else MARK_OF[mark]


def to_devanagari(text: str | None) -> str:
    """Roman letters with diacritics to Devanagari; what is in no table stays."""
    return SYLLABLE.sub(syllable, text or "")


@lru_cache(maxsize=1 << 16)
def word_in_devanagari(word: str) -> str:
    return to_devanagari(word)


ANY_DEVANAGARI = re.compile("[\u0900-\u097f]")


@F.pandas_udf(StringType())
def devanagari(texts: pd.Series) -> pd.Series:
    """Texts without a Devanagari letter from Roman letters; others as they are."""
    # No letter joins those of another word, so words are turned one by one, and frequent ones are remembered.
    return pd.Series([t if t and ANY_DEVANAGARI.search(t) else " ".join(map(word_in_devanagari, (t or "").split(" "))) for t in texts])


@F.pandas_udf(StringType())
def iast(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    """Texts of the given scripts in Roman letters, in NFC and without accent marks."""
    from unicodedata import normalize

    drop = {ord(c): None for c in MARKS}
    return pd.Series([normalize("NFC", to_iast(t, k)).translate(drop).strip() for t, k in zip(texts, kinds, strict=True)])


def processed(text: Column) -> dict[str, Column]:
    """original, cleaned, iast, ascii and length in words of a text."""
    clean = cleaned(text)
    roman = iast(clean, script(clean))
    return {"original": text, "cleaned": clean, "iast": roman, "ascii": ascii_form(roman), "length": F.size(tokens(roman))}


def preprocessed(df: DataFrame, text: str = "text", prefixes=PREFIXES, suffixes=SUFFIXES) -> DataFrame:
    """The rows with original, cleaned, iast, ascii, length, split_words, lemmas, parts_of_speech, lemmas_text and indexed.

    Words are cut into parts, and these are analysed in Devanagari, whatever they were written in; ``indexed`` is the lemmas' text, or the ascii form where that is empty.
    """
    named = df.withColumn("cleaned", cleaned(F.col(text)))
    named = named.withColumn("iast", iast(F.col("cleaned"), script(F.col("cleaned")))).withColumns({"original": F.col(text), "ascii": ascii_form(F.col("iast")), "length": F.size(tokens(F.col("iast")))})
    cut = named.withColumn("split_words", split_compounds(F.col("iast"), prefixes, suffixes))
    # Words have no gap, so their texts can be turned in one piece.
    turned = cut.withColumn("turned", devanagari(F.array_join("split_words", " "))).withColumn("turned", F.when(F.size("split_words") > 0, F.split("turned", " ")).otherwise(F.array().cast("array<string>")))
    analysed = turned.withColumns({"lemmas": F.transform("turned", lambda w: lemma(w)), "parts_of_speech": F.transform("turned", lambda w: part_of_speech(w))}).drop("turned")
    return analysed.withColumn("lemmas_text", F.array_join("lemmas", " ")).withColumn("indexed", F.coalesce(F.nullif(F.btrim("lemmas_text"), F.lit("")), F.col("ascii")))
