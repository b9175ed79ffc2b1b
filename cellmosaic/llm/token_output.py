"""Token ids as files of patched frame-of-reference blocks.

Documents are range-partitioned by id and sorted; each task encodes its documents with the ``tokenizers`` library and writes files of
about ``FILE_TOKENS`` ids to the shared folder. Ids are cut into blocks of ``BLOCK`` without regard to documents. A block stores its
minimum, and each id's distance from it in a fixed number of bits that holds all but the largest ones (``percentile``); those, the exceptions, stand in a
list of positions and high bits. A block index and a document table at the file's end allow range reads.

File: ``b"CMT1"``, blocks, zlib(document ids, int64), zlib(null flags, uint8), zlib(document lengths, uint32), block starts (uint64, one more than blocks), footer.
Block: minimum uint32, bits uint8, exceptions uint16, packed low bits (little-endian), positions uint16, high bits uint32.

A word is encoded once: words are found on the bytes, and each task keeps the ids of words it has met, in at most ``CACHE_WORDS``
entries. White space never joins two words in these vocabularies, so a text's ids are its words' ids in a row. The vocabulary must have
that property: a pre-tokenizer that drops white space.

Defined results: null is an empty text and gives the end id alone. Null ids sort first. Rows with equal ids stand in the order
of their texts' hashes. An empty table gives no files and no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.shared import new_path, written
from cellmosaic.llm.textblocks import Block, blocks

BLOCK, FILE_TOKENS, CACHE_WORDS = 4096, 8 << 20, 1_500_000
MAGIC, FOOTER = b"CMT1", struct.Struct("<QQIIIQI")  # tokens, documents, three lengths, where the tables start, blocks
_HEAD = struct.Struct("<IBH")
# letters whose lower case and normal form are single letters, with punctuation around them: such a word has one token group for each part
_PLAIN = re.compile(r"([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*)")


class WordEncoder:
    """Ids of whole blocks of documents; each distinct word goes through the library once while it stays in the cache."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), cache_words
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.length, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        out: list = [None] * len(words)
        plain, groups = [], []
        for k, w in enumerate(words):
            m = _PLAIN.fullmatch(w)
            if m and len(w) < 200:
                plain.append(k)
                groups.append((m.start(1) < m.end(1)) + (m.start(2) < m.end(2)) + (m.start(3) < m.end(3)))
        many = [" ".join([words[k] for k in plain[i : i + 128]]) for i in range(0, len(plain), 128)]
        ids = [x.ids for x in self.library.encode_batch_fast(many, add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        ends = np.flatnonzero(self.ends[flat]) + 1
        through = np.cumsum(np.array(groups, np.int64))
        if len(plain) and len(ends) == through[-1]:
            stop = ends[through - 1]
            for k, a, b in zip(plain, np.append(0, stop[:-1]), stop, strict=True):
                out[k] = flat[a:b]
        odd = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(odd, self.library.encode_batch_fast([words[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = np.array(x.ids, np.int32)
        return out

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's documents, and how many each document has."""
        start, end, first = block.words()
        keys, where, inverse = np.unique(block.hashes(start, end), return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        known = (self.keys[np.minimum(slot, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + (~known).sum() > self.most:
                self._forget()
                known[:] = False
            data, new = block.buf.tobytes(), np.flatnonzero(~known)
            ids = self.words([data[start[k] : end[k]].decode() for k in where[new]])
            length = np.array([len(x) for x in ids], np.int32)
            at = len(self.pool) + np.cumsum(length) - length
            put = np.searchsorted(self.keys, keys[new])
            self.pool = np.concatenate([self.pool, *ids])
            self.keys, self.at, self.length = np.insert(self.keys, put, keys[new]), np.insert(self.at, put, at), np.insert(self.length, put, length)
            slot = np.searchsorted(self.keys, keys)
        length, at = self.length[slot][inverse].astype(np.int64), self.at[slot][inverse]
        through = np.cumsum(length)
        ids = self.pool[np.repeat(at - (through - length), length) + np.arange(through[-1] if len(through) else 0)]
        before = np.append(0, through)
        return ids, before[first[1:]] - before[first[:-1]]


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One encoder a worker process."""
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = WordEncoder(path, cache_words)
    return _encoders[path, cache_words]


def pack_block(ids: np.ndarray, percentile: float = 98.0) -> bytes:
    """One block of at most 65,535 ids."""
    low = int(ids.min())
    v = (ids.astype(np.int64) - low).astype("<u4")
    bits = int(np.percentile(v, percentile, method="higher")).bit_length()
    high = v >> np.uint32(bits) if bits < 32 else np.zeros_like(v)
    odd = np.flatnonzero(high)
    size = 2 if bits <= 16 else 4
    low_bits = (v & np.uint32((1 << bits) - 1)).astype(f"<u{size}")
    packed = np.packbits(np.unpackbits(low_bits.view(np.uint8).reshape(-1, size), axis=1, bitorder="little")[:, :bits], bitorder="little")
    return _HEAD.pack(low, bits, len(odd)) + packed.tobytes() + odd.astype("<u2").tobytes() + high[odd].astype("<u4").tobytes()


def unpack_block(data: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    low, bits, odd = _HEAD.unpack_from(data)
    size, n_bytes = 2 if bits <= 16 else 4, (n * bits + 7) // 8
    flat = np.unpackbits(np.frombuffer(data, np.uint8, n_bytes, _HEAD.size), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, size * 8), np.uint8)
    wide[:, :bits] = flat
    v = np.packbits(wide, axis=1, bitorder="little").view(f"<u{size}").ravel().astype(np.uint32)
    at = _HEAD.size + n_bytes
    where = np.frombuffer(data, "<u2", odd, at)
    v[where] |= np.frombuffer(data, "<u4", odd, at + 2 * odd) << np.uint32(bits)
    return v + np.uint32(low)


def pack_file(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, percentile: float = 98.0) -> bytes:
    out, starts = [MAGIC], [len(MAGIC)]
    for k in range(0, len(ids), BLOCK):
        out.append(pack_block(ids[k : k + BLOCK], percentile))
        starts.append(starts[-1] + len(out[-1]))
    tables = [zlib.compress(x.tobytes()) for x in (np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), lengths.astype("<u4"))]
    out += [*tables, np.array(starts, "<u8").tobytes(), FOOTER.pack(len(ids), len(doc_ids), *map(len, tables), starts[-1], len(starts) - 1)]
    return b"".join(out)


@dataclass
class TokenFile:
    """Reads a file of blocks; ``read(offset, length)`` reads bytes of it."""

    read: object
    size: int

    def __post_init__(self):
        self.n_tokens, self.n_docs, a, b, c, at, n = FOOTER.unpack(self.read(self.size - FOOTER.size, FOOTER.size))
        tail = self.read(at, self.size - FOOTER.size - at)
        self.doc_ids = np.frombuffer(zlib.decompress(tail[:a]), "<i8")
        self.null = np.frombuffer(zlib.decompress(tail[a : a + b]), np.uint8).astype(bool)
        self.lengths = np.frombuffer(zlib.decompress(tail[a + b : a + b + c]), "<u4").astype(np.int64)
        self.starts = np.frombuffer(tail[a + b + c :], "<u8", n + 1).astype(np.int64)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start .. stop - 1``, from only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (stop - 1) // BLOCK + 1
        data = self.read(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
        cut = self.starts - self.starts[a]
        parts = [unpack_block(data[cut[k] : cut[k + 1]], min(BLOCK, self.n_tokens - k * BLOCK)) for k in range(a, b)]
        return np.concatenate(parts)[start - a * BLOCK : stop - a * BLOCK]


def open_file(path: str) -> TokenFile:
    fs, local = pafs.FileSystem.from_uri(path)
    f = fs.open_input_file(local)
    return TokenFile(lambda at, n: f.read_at(n, at), f.size())


def _writer(base: str, tokenizer: str, end_id: int, percentile: float, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer).encode
        fs, top = pafs.FileSystem.from_uri(base)
        fs.create_dir(top, recursive=True)
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        lengths: list[np.ndarray] = []
        n = 0

        def flush():
            nonlocal n, seq
            name = f"{uuid.uuid4().hex}.cmt"
            with fs.open_output_stream(f"{top}/{name}", compression=None) as f:
                f.write(pack_file(np.concatenate(held), docs, np.concatenate(lengths), percentile))
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([f"{base}/{name}"]), pa.array([len(docs)]), pa.array([n])], ["part", "seq", "file", "n_docs", "n_tokens"])
            held.clear(), docs.clear(), lengths.clear()
            n, seq = 0, seq + 1
            return row

        for batch in batches:
            own = batch.column("id").to_pylist()
            for block in blocks(batch.column("text"), 4 << 20):
                ids, length = encode(block)
                last = np.cumsum(length + 1) - 1
                with_end = np.full(len(ids) + block.n, end_id, np.int32)
                body = np.ones(len(with_end), bool)
                body[last] = False
                with_end[body] = ids
                held.append(with_end)
                docs += own[block.first : block.first + block.n]
                lengths.append(length + 1)
                n += len(with_end)
                if n >= file_tokens:
                    yield flush()
        if n:
            yield flush()

    return write


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, percentile: float = 98.0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS
) -> DataFrame:
    """Writes the files; returns ``file, n_docs, n_tokens, start`` of each, in the order of document ids.

    ``tokenizer``: path of a ``tokenizers`` JSON file that every executor can read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # equal rows have their place in the input as a third key, so that a third of all rows with one id and text still spreads over ranges
    keyed = own.withColumns({"mark": F.xxhash64("text"), "spread": F.monotonically_increasing_id() % 4096})
    ordered = keyed.repartitionByRange("id", "mark", "spread").sortWithinPartitions("id", "mark").select("id", "text")
    base = new_path(docs.sparkSession, "tokens")
    files = written(ordered.mapInArrow(_writer(base, tokenizer, end_id, percentile, file_tokens), "part long, seq long, file string, n_docs long, n_tokens long"), "token-files")
    # one row a file of millions of ids: sums by task first, then inside each
    tasks = files.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    before = tasks.select("part", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inside", inside).join(before, "part").select("file", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = open_file(row["file"])
                through = np.cumsum(f.lengths)
                a = 0
                while a < f.n_docs:  # a few million ids at a time
                    base = int(through[a] - f.lengths[a])
                    b = max(a + 1, int(np.searchsorted(through, base + (2 << 20), "right")))
                    ids = f.tokens(base, int(through[b - 1])).astype("<u4")
                    cut = np.append(0, through[a:b] - base)
                    view = memoryview(ids.tobytes())
                    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    cols = [pa.array(f.doc_ids[a:b], mask=f.null[a:b]), pa.array(row["start"] + base + cut[:-1]), pa.array(f.lengths[a:b]), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    a = b

    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = max(1, files.count())  # a task a file: the rows are few and small, the files are not
    return files.repartition(n, "file").mapInArrow(read, schema)
