"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a word's prefix ends with one token only.  A token that ends there is that token exactly if the
last token of the prefix before it goes together with it, that is if the pair, encoded as one text, stays that
pair.  An automaton over all tokens gives those that end at each place, longest first; the last token of each
prefix is stored, and the ids are read off from the end of the word backwards.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import per_process, text_of

#: Units of text, words and token pairs that a task remembers; beyond it, that memory starts anew.
REMEMBERED = 250_000
END = "\0"
NEVER = 1 << 40


class PrefixBpe:
    """A tokenizer file of the kind byte-level BPE with word ends: lower case, and white space dropped."""

    def __init__(self, path: str):
        import re

        from ahocorasick import Automaton
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or not suffix or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError("not a tokenizer of this kind")
        self.content = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        own = {i: t.removesuffix(suffix) + END if t.endswith(suffix) else t for t, i in model["vocab"].items()}
        ids = {t: i for i, t in own.items()}
        self.rank, self.parts, self.made_at = {}, {}, {}
        for r, (a, b) in enumerate(model["merges"]):
            a, b = (x.removesuffix(suffix) + END if x.endswith(suffix) else x for x in (a, b))
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.parts:
                self.parts[whole], self.made_at[whole] = pair, r
        self.ends = Automaton()
        sound: dict[int, bool] = {}
        for t in sorted(own, key=lambda t: len(own[t])):
            sound[t] = len(own[t].rstrip(END)) == 1 if t not in self.parts else all(sound[x] for x in self.parts[t]) and self._together(*self.parts[t], self.made_at[t])
            if sound[t]:
                self.ends.add_word(own[t], (t, len(own[t])))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self.units: dict[bytes, tuple[int, str, str]] = {}
        # Which characters are letters, and their lower case, is the library's to say; for these it is beyond doubt.
        runs = "[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u012F\u0131-\u017F]+", r"[!-&(-/:;=>?@\[-`{-~]+"
        self.plain, self.find = re.compile("(?:" + "|".join([*runs, "[0-9]"]) + ")*").fullmatch, re.compile("|".join([*runs, "[0-9]"])).findall
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda x: [x]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """What stands at one edge of a token while it is built: each piece and the merge that ends it."""
        pieces, until = [], NEVER
        while True:
            pieces.append((t, until))
            if t not in self.parts:
                return pieces[::-1]
            until = self.made_at[t]
            t = self.parts[t][side]

    def _together(self, left: int, right: int, limit: int = NEVER) -> bool:
        """Whether no merge before ``limit`` joins something across the border of two tokens as they are built side by side."""
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            merge = self.rank.get((x, y), NEVER)
            # Of equal merges the one further left goes first: x ends before the border pair, y after it.
            if merge < min(x_until, limit) and merge <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _goes(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self._together(left, right)
        return found

    def word(self, mapped: str) -> list[int]:
        """The ids of one pre-token, given with a character for each byte."""
        if (found := self.words.get(mapped)) is not None:
            return found
        word, mapped = mapped, mapped + END
        last, size = [-1] * (len(mapped) + 1), [0] * (len(mapped) + 1)
        for end, (t, n) in self.ends.iter(mapped):
            if last[end + 1] < 0 and (n == end + 1 or (last[end + 1 - n] >= 0 and self._goes(last[end + 1 - n], t))):
                last[end + 1], size[end + 1] = t, n
        ids, at = [], len(mapped)
        while at:
            if last[at] < 0:
                raise ValueError(f"no token for a part of {word!r}")
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _ids(self, unit: str) -> list[int]:
        if self.plain(unit):
            words = self.find(unit.lower())
            if not unit.isascii():
                words = [w.encode().decode("latin-1").translate(self.byte_chars) for w in words]
            return [t for w in words for t in self.word(w)]
        ids: list[int] = []
        for part in self.cut_special(unit):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    ids += self.word(w)
        return ids

    def _unit(self, unit: bytes) -> tuple[int, str, str]:
        ids = self._ids(unit.decode())
        found = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(self.units) >= REMEMBERED:
            self.units.clear()
        self.units[unit] = found
        return found

    def encode(self, text: str) -> list[int]:
        """The ids of a text; white space of ASCII ends words, so the units between are taken one by one."""
        ids: list[int] = []
        for unit in text.encode().split():
            ids += self._ids(unit.decode())
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.content.__getitem__, ids))

    def both(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by a space, and the decoded text."""
        known = self.units.get
        found = [known(u) or self._unit(u) for u in text.encode().split()]
        found = [x for x in found if x[0]]
        return sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded text of each row of ``docs(doc_id, text)``; see ``encoded_digests`` for what is empty or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_process(("bpe", tokenizer), lambda: PrefixBpe(tokenizer))
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [bpe.encode(x.as_py()) for x in part[1]]
                yield pa.RecordBatch.from_pydict({"doc_id": part[0], "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": [bpe.decode(x) for x in ids]})

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs(doc_id, text)``, whole texts.

    A null or empty text, or one of white space, has no id and decodes to the empty text.  Rows that repeat are
    encoded each; null ids are passed through; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_process(("bpe", tokenizer), lambda: PrefixBpe(tokenizer))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [(n, sha(ids), sha(text)) for n, ids, text in (bpe.both(x.as_py()) for x in part[1])]
                n, ids, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": part[0], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(text, pa.string())})

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

