"""Token ids as files of compressed planes: encode, write, index, read back.

A file holds blocks of up to BLOCK ids. A block's ids are transposed into byte
or bit planes and each plane is compressed with zstandard by itself: the high
planes of small ids are nearly constant and cost almost nothing. Layout:

    b"QTP1" | planes of block 0 | planes of block 1 | ... | index | index length (8 bytes) | b"QTP1"

The index is compressed binary: kind of plane, number of blocks, documents,
ids, and documents without an id, which come first; then per block its offset
and ids, per plane its length, and per document its id and number of ids, as
little-endian arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qvault.llm.features import release_memory
from qvault.llm.files import make_folder, resolve, unique_name
from qvault.storage import materialize, new_path

MAGIC = b"QTP1"
BLOCK = 1 << 16
#: Text that is encoded at once, in bytes: bounds a task's memory however long a batch is.
SLICE_BYTES = 8 << 20
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of uint32 ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [raw[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, i]).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4").astype(np.uint32, copy=False)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8))[:n] for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4").astype(np.uint32, copy=False)


class PlaneWriter:
    """Writes ids and documents to one file; holds at most a block of ids, and 16 bytes per document."""

    def __init__(self, uri: str, kind: str = "byte", level: int = 3):
        system, path = resolve(uri)
        self.out = system.open_output_stream(path)
        self.kind, self.zip = kind, zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.offsets, self.counts, self.lengths = [], [], []
        self.doc_ids, self.doc_tokens, self.n_null = [], [], 0

    def add(self, doc_ids: np.ndarray, doc_tokens: np.ndarray, ids: np.ndarray, n_null: int = 0) -> None:
        """Adds documents; of all that are added, those without an id come first, and ``n_null`` counts them."""
        self.n_null += n_null
        self.doc_ids.append(doc_ids)
        self.doc_tokens.append(doc_tokens)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            held = np.concatenate(self.waiting)
            full = len(held) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self._block(held[i : i + BLOCK])
            self.waiting, self.n_waiting = [held[full:]], len(held) - full

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        self.offsets.append(self.at)
        self.counts.append(len(ids))
        self.lengths.append([len(p) for p in planes])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        """Ends the file; returns its documents and ids."""
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        docs = np.concatenate(self.doc_ids) if self.doc_ids else np.empty(0, np.int64)
        tokens = np.concatenate(self.doc_tokens) if self.doc_tokens else np.empty(0, np.int64)
        head = np.array([self.kind == "bit", len(self.counts), len(docs), sum(self.counts), self.n_null], "<i8")
        arrays = [head, np.array(self.offsets, "<i8"), np.array(self.counts, "<i8"), np.array(self.lengths, "<i8").reshape(-1), docs.astype("<i8"), tokens.astype("<i8")]
        index = self.zip.compress(b"".join(a.tobytes() for a in arrays))
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return len(docs), int(head[3])


class PlaneReader:
    """Random access to a file of planes by way of its index."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 12)
        tail = self.file.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"not a file of token planes: {uri}")
        length = int.from_bytes(tail[:8], "little")
        self.file.seek(size - 12 - length)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.file.read(length)), "<i8")
        bit, blocks, docs, self.n_ids, self.n_null = (int(x) for x in raw[:5])
        self.kind, planes = ("bit", 32) if bit else ("byte", 4)
        parts = np.split(raw[5:], np.cumsum([blocks, blocks, blocks * planes, docs]))
        self.offsets, self.counts, self.lengths = parts[0], parts[1], parts[2].reshape(blocks, planes)
        self.doc_ids, self.doc_tokens = parts[3], parts[4]

    def block(self, i: int) -> np.ndarray:
        self.file.seek(int(self.offsets[i]))
        unzip, n = zstandard.ZstdDecompressor(), int(self.counts[i])
        return from_planes([unzip.decompress(self.file.read(int(x))) for x in self.lengths[i]], n, self.kind)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on; only the blocks that hold them are read."""
        first, last = start // BLOCK, max(start, start + n - 1) // BLOCK
        held = [self.block(i) for i in range(first, min(last + 1, len(self.counts)))]
        return np.concatenate(held)[start - first * BLOCK :][:n] if held else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(doc_id or None, ids, crc32 of the ids as little-endian uint32) in the file's order, one block in memory at a time."""
        i, held, at = 0, np.empty(0, np.uint32), 0
        ids = [None] * self.n_null + self.doc_ids[self.n_null :].tolist()
        for doc, n in zip(ids, self.doc_tokens.tolist(), strict=True):
            crc, left = 0, n
            while left:
                if at == len(held):
                    held, at, i = self.block(i), 0, i + 1
                taken = held[at : at + left]
                crc = zlib.crc32(taken.astype("<u4").tobytes(), crc)
                at += len(taken)
                left -= len(taken)
            yield doc, n, crc


#: Letters that stay one piece of a word, whatever stands beside them: a-z and the lower-case letters of Latin-1.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
SPECIAL = "<|"


def prepared(texts: pa.Array) -> pa.Array:
    """Texts that encode alike and repeat fewer words: A-Z in lower case, and a blank before marks that end a word.

    The tokenizer lowers case and parts letters from marks by itself. Texts
    that might hold a special token, which is found before that, stay.
    """
    lowered = pc.ascii_lower(texts)
    parted = pc.replace_substring_regex(lowered, f"([{LETTERS}])([.,;:!?]+)(\\s|$)", "\\1 \\2\\3")
    return pc.if_else(pc.match_substring(texts, SPECIAL), texts, parted)


class WordEncoder:
    """Encodes texts whose words the tokenizer treats one by one, each distinct word once.

    Right for tokenizers that lower case, drop white space and never join what
    it parts, such as word_bpe_49k.json; others take ``by_word=False``.
    """

    #: Words that are encoded in one call.
    TOGETHER = 2000

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.lengths, self.flat = np.empty(0, np.int64), np.empty(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(words, pa.string()), f"^[{LETTERS}]+$").to_pylist()
        whole = [w for w, p in zip(words, plain, strict=True) if p]
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        lengths, ids = [], []
        for i in range(0, len(whole), self.TOGETHER):
            some = whole[i : i + self.TOGETHER]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            lengths.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(e.ids, np.uint32))
        for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False):
            lengths.append([len(e.ids)])
            ids.append(np.array(e.ids, np.uint32))
        self.slots.update(zip(whole + rest, range(len(self.slots), len(self.slots) + len(words)), strict=True))
        self.lengths, self.flat = np.concatenate([self.lengths, *lengths]).astype(np.int64), np.concatenate([self.flat, *ids])

    def _slots(self, words: list[str]) -> np.ndarray:
        known = self.slots
        new = [w for w in words if w not in known]
        if new and len(known) + len(new) > self.cache_words:
            self._forget()
            known, new = self.slots, words
        if new:
            self._learn(new)
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text)."""
        lists = pc.ascii_split_whitespace(prepared(texts))
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())
        index = slots[coded.indices.to_numpy(zero_copy_only=False)]
        offsets = np.cumsum(self.lengths) - self.lengths
        n = self.lengths[index]
        ends = np.cumsum(n)
        at = np.repeat(offsets[index] - (ends - n), n)
        at += np.arange(len(at))
        total = np.concatenate(([0], ends))
        return self.flat[at], np.diff(total[bounds - bounds[0]])

    def encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].cache_words = cache_words
    return _encoders[path]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + size, "right")))
        yield first, last - first
        first = last


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str, end_id: int = 1, kind: str = "byte", by_word: bool = True, slice_bytes: int = SLICE_BYTES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into files in ``folder``; returns the manifest.

    Documents are sorted by range over the cluster; each task streams its range
    into one file. The manifest (part, file, n_docs, n_ids) lists the files of
    the attempts that ended; read only those. Null texts count as empty: the
    end id alone. Null doc_ids come first; the index counts them. Rows that repeat a doc_id follow each other, ordered by text.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name = unique_name(part, ".qtp")
        coder, out = encoder(tokenizer, cache_words), None
        for b in batches:
            out = out or PlaneWriter(f"{folder}/{name}", kind)
            named, ids = b.column(0).is_valid().to_numpy(zero_copy_only=False), pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            texts = pc.fill_null(b.column(1), "")
            for first, n in slices(texts, slice_bytes):
                part_of = texts.slice(first, n)
                tokens, counts = coder.encode(part_of) if by_word else coder.encode_whole(part_of)
                ended = np.insert(tokens, np.cumsum(counts), end_id).astype(np.uint32)
                out.add(ids[first : first + n], counts + 1, ended, int((~named[first : first + n]).sum()))
            release_memory()
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files that ``manifest`` lists.

    Each task reads files block by block. ``start`` counts the ids of all
    documents before, over all files: a running sum over the manifest, which
    has one row per file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                start, rows = r["first"], []
                for doc, n, crc in PlaneReader(f"{folder}/{r['file']}").documents():
                    rows.append((doc, start, n, crc))
                    start += n
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n_files = manifest.count()  # a number of partitions is kept, and deals out rows by turns: one file each
    spread = placed.select("file", "first").repartition(max(1, n_files))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_to_files(docs: DataFrame, *, tokenizer: str, end_id: int = 1, kind: str = "byte", by_word: bool = True, folder: str | None = None, **bounds) -> DataFrame:
    """Write ``docs`` as token files and read them back: one row per document. An empty table gives no file and no row."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    manifest, _ = materialize(write_token_files(docs, folder, tokenizer=tokenizer, end_id=end_id, kind=kind, by_word=by_word, **bounds), "manifest")
    return read_token_files(manifest, folder)
