"""Token ids in files of fixed-width codes.

A file holds ids in blocks of ``BLOCK`` ids, each id in the fewest bits that the vocabulary needs.  A footer
holds the byte offset of every block and the documents with the position of their first id, so any range
of ids is found by one seek and unpacked with a few array operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import open_store, per_process, put_file, run_dir, text_of

MAGIC = b"LDTOKEN1"
TAIL = "<QQQQHI8s"
BLOCK = 1 << 16
#: Runs of letters or signs whose ids a task remembers, and as many from before; code points of text that it encodes in one go; runs in a call of the library.
REMEMBERED, AT_ONCE, IN_A_CALL = 250_000, 1 << 22, 1 << 14


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side, lowest bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """``n`` ids of a packed block from the id at ``first`` on."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, 2 * first).astype(np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    raw = np.frombuffer(data + bytes(8), np.uint8)
    word = np.zeros(n, np.uint64)
    for k in range(5):
        word |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Streams ids into an open file, a block at a time."""

    def __init__(self, out, bits: int):
        self.out, self.bits = out, bits
        self.offsets, self.doc_ids, self.starts = [], [], []
        self.written, self.n_ids, self.held, self.n_held = len(MAGIC), 0, [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document with its first ids."""
        self.doc_ids.append(-1 if doc_id is None else doc_id)
        self.starts.append(self.n_ids)
        self.add_ids(ids)

    def add_ids(self, ids: np.ndarray) -> None:
        """More ids of the last document."""
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for k in range(0, end, BLOCK):
            data = pack(ids[k : min(k + BLOCK, end)], self.bits)
            self.offsets.append(self.written)
            self.written += len(data)
            self.out.write(data)
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(True)
        for part in (np.array(self.offsets, "<u8"), np.array(self.doc_ids, "<i8"), np.array(self.starts, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(struct.pack(TAIL, len(self.offsets), len(self.doc_ids), self.n_ids, self.written, self.bits, BLOCK, MAGIC))


class TokenFile:
    """Random access to the ids of one file: the footer is read once, and of the blocks only those that are asked for.

    ``source`` is the file's bytes or an open file with ``size``, ``seek``, ``read`` and ``read_at``.
    """

    def __init__(self, source):
        self.file = pa.BufferReader(source) if isinstance(source, (bytes, memoryview)) else source
        size, tail = self.file.size(), struct.calcsize(TAIL)
        blocks, docs, self.n_ids, footer, self.bits, self.block, magic = struct.unpack(TAIL, bytes(self.file.read_at(tail, size - tail)))
        if magic != MAGIC or bytes(self.file.read_at(len(MAGIC), 0)) != MAGIC:
            raise ValueError("not a token file")
        lists = bytes(self.file.read_at(8 * (blocks + 2 * docs), footer))
        self.offsets = np.frombuffer(lists, "<u8", blocks)
        self.ends = np.append(self.offsets[1:], np.uint64(footer))
        self.doc_ids = np.frombuffer(lists, "<i8", docs, 8 * blocks)
        self.starts = np.frombuffer(lists, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)
        self.held: tuple[int, bytes] = (-1, b"")

    def _block(self, b: int) -> bytes:
        """The packed block, read unless it is the one that was read last."""
        if self.held[0] != b:
            self.held = b, bytes(self.file.read_at(int(self.ends[b] - self.offsets[b]), int(self.offsets[b])))
        return self.held[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start`` on, read from their blocks alone."""
        parts = []
        while n > 0:
            b, first = divmod(start, self.block)
            take = min(n, self.block - first)
            parts.append(unpack(self._block(b), self.bits, first, take))
            start, n = start + take, n - take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        end = self.starts[k + 1] if k + 1 < len(self.starts) else self.n_ids
        return self.ids(int(self.starts[k]), int(end - self.starts[k]))


def gathered(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat``, whose stretches have these ``sizes``, one after the other; and where each ends, after a 0."""
    begins = np.cumsum(sizes) - sizes
    n = sizes[at]
    ends = np.r_[0, np.cumsum(n)]
    steps = np.repeat((begins[at] - ends[:-1]).astype(np.int32), n)  # a few million ids at most
    steps += np.arange(ends[-1], dtype=np.int32)
    return flat[steps], ends


class Memory:
    """Keys with their ids, in arrays: the first keys for ever, and of others those met of late."""

    def __init__(self, size: int, first: dict[str, list[int]]):
        self.size, self.turn, self.keys = size, 0, pa.array([*first], pa.large_string())
        self.ids, self.sizes = np.array([i for ids in first.values() for i in ids], "<u4"), np.array([*map(len, first.values())], np.int64)
        self.met = np.full(len(first), np.iinfo(np.int64).max)

    def places(self, keys: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The places of different keys; those that are not known are encoded."""
        import pyarrow.compute as pc

        known = pc.index_in(keys, self.keys)
        new = keys.filter(pc.is_null(known))
        at = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.turn += 1
        old = at >= 0
        self.met[at[old]] = np.maximum(self.met[at[old]], self.turn)
        if len(self.keys) + len(new) > self.size:
            # Half of them go, those met longest ago, but none of these keys.
            stay = np.argsort(-self.met, kind="stable")[: max(self.size // 2, int((self.met >= self.turn).sum()))]
            moved = np.empty(len(self.keys), np.int64)
            moved[stay] = np.arange(len(stay))
            at[old] = moved[at[old]]
            self.ids, _ = gathered(self.ids, self.sizes, stay)
            self.keys, self.sizes, self.met = self.keys.take(pa.array(stay)), self.sizes[stay], self.met[stay]
        if len(new):
            ids, sizes = encode(new)
            at[~old] = len(self.keys) + np.arange(len(new))
            self.keys, self.ids, self.sizes = pa.concat_arrays([self.keys, new]), np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.met = np.concatenate([self.met, np.full(len(new), self.turn)])
        return at


class UnitEncoder:
    """The tokenizers library on the different units of many texts, whose ids are then put together as the texts have them.

    A text is cut before each space that a character other than white space follows.  Byte-level
    pre-tokenization never joins the two sides of such a cut, nor does it look across one, so the ids of
    the units in a row are the ids of the whole text.  The pre-tokens of a plain unit, one with single line ends inside at most, are
    its runs of letters, digits and signs; most units are one run, with signs behind it or not, and are cut in Arrow arrays.  The different runs, but those remembered, go to the library's BPE model with line ends between them to tell where
    each one's ids end; any other unit goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The same model on pieces that are cut already.
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\x1f")
        self.odd, self.cut = re.compile(r" (?:\s|\Z)").search, re.compile(r" (?=\S)").split
        # Letters up to U+02AF, digits, and ASCII signs but for the apostrophe and "<", which start contractions and special tokens.
        runs = "[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\u02AF]+", "[0-9]+", r"[!-&(-/:;=>?@\[-`{-~]+"
        any_run = "(?:" + "|".join(runs) + ")+"
        self.plain = f"^{any_run}(?:\n{any_run})*$"
        self.one_run, self.signs = f"^(?:{runs[0]}|{runs[1]})?$", "".join(re.findall(runs[2], "".join(map(chr, range(128)))))
        self.runs = re.compile("|".join([*(f" ?{r}" for r in runs), "\n", "\0"])).findall
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100 on
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        self.line_end = self.tokenizer.token_to_id(self.byte_chars[10])
        self.known = Memory(2 * REMEMBERED, {"\0": [], "\n": [self.line_end]})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, fresh: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without line ends, one after the other, and how many each has; some thousand runs in a call, as the library keeps far more of a token than its id."""
        import pyarrow.compute as pc

        end, ids, sizes = self.byte_chars[10], [], []
        for k in range(0, len(fresh), IN_A_CALL):
            part = fresh.slice(k, IN_A_CALL)
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(part)], pa.int64()), part), pa.scalar("\n", pa.large_string()))
            mapped = str(joined[0].as_buffer(), "latin-1").translate(self.byte_chars).replace(end, f"\x1f{end}\x1f")
            found = np.array(self.pieces.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            is_end = found == self.line_end
            ids.append(found[~is_end])
            sizes.append(np.diff(np.r_[-1, np.flatnonzero(is_end), len(found)]) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _plain(self, units: pa.Array, stems: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain units one after the other, and how many each has: of those that are one run, their ``stems``, and signs, then of others."""
        import pyarrow.compute as pc

        text = lambda x: pa.scalar(x, pa.large_string())
        n = len(units)
        # Signs alone are a run of their own.
        heads = pc.if_else(pc.equal(stems, text("")), units, stems)
        behind = pc.subtract(pc.binary_length(units), pc.binary_length(heads)).to_numpy(zero_copy_only=False).astype(np.int64)
        has = np.flatnonzero(behind)
        _, offsets, letters = units.buffers()
        begins, taken = np.frombuffer(offsets, "<i8", n + 1, 8 * units.offset)[1:][has] - behind[has] if n else has, np.cumsum(behind[has])
        data = np.frombuffer(letters or b"", np.uint8)[np.repeat(begins - (taken - behind[has]), behind[has]) + np.arange(behind.sum())]
        tails = pa.LargeStringArray.from_buffers(len(has), pa.py_buffer(np.r_[0, taken].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
        cut = self.runs("\0 " + "\0 ".join(others.to_pylist())) if len(others) else []
        found = pa.concat_arrays([pc.binary_join_element_wise(text(""), heads, text(" ")), tails, pa.array(cut, pa.large_string())]).dictionary_encode()
        at = self.known.places(found.dictionary, self._runs)[found.indices.to_numpy(zero_copy_only=False)]
        # Two places for each unit of one run, the second of the empty key if nothing is behind it.
        two = np.zeros((n, 2), np.int64)
        two[:, 0], two[has, 1] = at[:n], at[n : n + len(has)]
        cut_at = at[n + len(has) :]
        ids, ends = gathered(self.known.ids, self.known.sizes, np.concatenate([two.ravel(), cut_at]))
        starts = 2 * n + np.flatnonzero(cut_at == 0)
        return ids, np.diff(np.r_[ends[0 : 2 * n : 2], ends[starts], ends[-1]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        import pyarrow.compute as pc

        kind = pa.large_list(pa.large_string())
        odd = [k for k, t in enumerate(texts) if self.odd(t)]
        even = sorted({*range(len(texts))}.difference(odd))
        split = [pc.split_pattern(pa.array([texts[k] for k in even], pa.large_string()), " ").cast(kind), pa.array([self.cut(texts[k]) for k in odd], kind)]
        units = pa.concat_arrays(split)
        first = np.r_[0, np.cumsum(pc.list_value_length(units).to_numpy(zero_copy_only=False))]
        values = units.flatten()
        tail = np.ones(len(values), bool)
        tail[first[:-1]] = False  # the first unit has no space before it
        heads = values.take(pa.array(first[:-1])).to_pylist()
        found = values.filter(pa.array(tail)).dictionary_encode()
        del units, values, split
        stems = pc.ascii_rtrim(found.dictionary, characters=self.signs)
        is_run = pc.match_substring_regex(stems, self.one_run)
        is_plain = pc.and_not(pc.match_substring_regex(found.dictionary, self.plain), is_run)
        is_other = pc.invert(pc.or_(is_run, is_plain))
        others = [self._whole(" " + u) for u in found.dictionary.filter(is_other).to_pylist()]
        ids, sizes = self._plain(found.dictionary.filter(is_run), stems.filter(is_run), found.dictionary.filter(is_plain))
        # Units of one run come first in what the ids are gathered from, then plain ones, then the others.
        kinds = [np.flatnonzero(k.to_numpy(zero_copy_only=False)) for k in (is_run, is_plain, is_other)]
        place = np.empty(len(stems), np.int64)
        place[np.concatenate(kinds)] = np.arange(len(stems))
        flat = np.concatenate([ids, np.frombuffer(b"".join(others), "<u4")])
        sizes = np.concatenate([sizes, np.fromiter(map(len, others), np.int64, len(others)) // 4])
        ids, ends = gathered(flat, sizes, place[found.indices.to_numpy(zero_copy_only=False)])
        cuts = ends[first - np.arange(len(first))]
        out: list[np.ndarray] = [None] * len(texts)
        for k, h, a, b in zip([*even, *odd], heads, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[k] = np.concatenate([np.frombuffer(self._whole(h), "<u4"), ids[a:b]]) if h else ids[a:b]
        del ids, found, stems
        pa.default_memory_pool().release_unused()  # several workers share what an executor has beside its heap
        return out


def some(ids: list, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Documents in a row with about ``AT_ONCE`` code points together, or a longer one by itself."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield ids[first : k + 1], held
            first, held, size = k + 1, [], 0
    if held:
        yield ids[first:], held


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write the ids in ascending ``doc_id`` order, return the list of files.

    Null texts count as empty, and every document, empty ones too, ends with ``end_id``.  Rows that share
    a ``doc_id`` follow each other in text order; a null ``doc_id`` comes first and is kept as -1 in the file.  Other
    columns are ignored.  An empty table makes no file.  Columns: path, n_ids, n_docs, first_doc, start
    (ids in all files before).
    """
    spark = docs.sparkSession
    folder = folder or run_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        uri = f"{folder}/part-{TaskContext.get().partitionId():06d}.tok"
        encoder, told = per_process(("tokens", tokenizer), lambda: UnitEncoder(tokenizer)), {}
        bits = max(1, max(encoder.tokenizer.get_vocab_size() - 1, end_id).bit_length())
        end = np.array([end_id], np.uint32)

        def fill(out):
            w, b = Writer(out, bits), head
            while b is not None:
                for ids, texts in some(b[0].to_pylist(), b[1]):
                    for doc_id, found in zip(ids, encoder.encode(texts), strict=True):
                        w.add(doc_id, found)
                        w.add_ids(end)
                b = next(batches, None)
            w.close()
            told.update(n_ids=w.n_ids, n_docs=len(w.doc_ids), first=w.doc_ids[0])

        put_file(uri, fill)
        yield pa.RecordBatch.from_pydict({"path": [uri], "n_ids": [told["n_ids"]], "n_docs": [told["n_docs"]], "first_doc": [told["first"]]})

    files = (
        docs.select("doc_id", text_of(docs).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "path string, n_ids long, n_docs long, first_doc long")
    )
    listed = run_dir(spark, "token-files")
    files.write.parquet(listed)
    # One row for each file, however long the texts are.
    before = Window.orderBy("first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(files.schema).parquet(listed).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document of the listed files: doc_id, start, n_tokens, ids_crc32.

    ``files`` is what ``write_token_files`` returned; the ids are read from the files alone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
                system, at = open_store(path)
                f = TokenFile(system.open_input_file(at))
                ends = np.append(f.starts[1:], f.n_ids)
                for k in range(0, len(f.starts), 4096):
                    crc = [zlib.crc32(f.document(d).astype("<u4").tobytes()) for d in range(k, min(k + 4096, len(f.starts)))]
                    part = slice(k, k + len(crc))
                    ids = [None if x == -1 else int(x) for x in f.doc_ids[part]]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(ids, pa.int64()), "start": f.starts[part] + start, "n_tokens": ends[part] - f.starts[part], "ids_crc32": pa.array(crc, pa.int64())}
                    )

    n = max(1, files.count())
    return files.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer))
