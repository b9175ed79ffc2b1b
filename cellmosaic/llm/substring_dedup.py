"""Substring dedup: passages that another document with a smaller id has too, found by compressed FM-indexes over shards.

1. Every window of ``window`` words is named by its smallest hashed ``SEED``-word gram. Neighbouring windows with one name, at most ``LONGEST`` of them, form a segment; equal
   windows have equal names, so they lie in segments of the same name. Names that only one document has are done with: nothing in them repeats.
2. Equal segments become one, with its smallest document; in all larger documents the whole segment goes. Each name goes to a shard, and the words of its distinct segments with it.
   A name with more than ``HOT`` distinct segments is split: its windows become segments of their own, dealt by their content.
3. In each shard a compressed FM-index (see ``fm_index``) is built over the segments that have a later one of their name, later by smallest document. Those that have an earlier one are
   the documents' words that are streamed through it: backward search keeps the matching statistics, and where a match reaches ``window`` words, its interval
   gives the smallest document that has the window. So a name with two distinct segments has one in the index and one in the stream.
4. Intervals found in a smaller document come back to their documents, and these lose the words that are covered.

So text is moved twice, and repeated passages once more however often they occur; no task holds more than one shard.

Defined results: null and empty texts have no words. Rows with equal ids don't count as smaller than each other, nor do null ids, which count as
larger than all others. Repeated rows get equal results. A word that fills a text makes equal segments, which count once. An empty table gives an empty result. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.llm.fm_index import NONE, FMIndex
from cellmosaic.llm.shared import written
from cellmosaic.llm.textblocks import Block, _power, blocks, joined_words, mix, shingles

SEED, HOT, SHARD_WORDS, LONGEST = 8, 2048, 2_000_000, 64
BROADCAST_NAMES = 500_000  # hot names up to here go out with the tasks, more of them by a join
_FAR = (1 << 63) - 1
_SEGMENT = "name long, content long, id long, mark long, start int, n int"


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values in a row."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def _spans(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of ``words[start:stop]``."""
    up, down = _power(len(words))
    sums = np.append(np.uint64(0), np.cumsum(words * up[: len(words)]))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def _segments(window: int, hot: np.ndarray | None):
    """All segments; or, of the names in ``hot`` only, each window as a segment named by its content."""
    seed = min(SEED, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            for block in blocks(batch.column("text")):
                start, end, first = block.words()
                length = np.diff(first)
                if not len(length) or length.max() < window:
                    continue
                words = block.hashes(start, end)
                name = _least_of(shingles(words, seed), window - seed + 1)
                edge = np.zeros(len(words) + 2, np.int32)
                long = length >= window
                np.add.at(edge, first[:-1][long], 1)
                np.add.at(edge, first[1:][long] - window + 1, -1)
                valid = np.cumsum(edge)[: len(name)] > 0
                if hot is not None:
                    at = np.flatnonzero(valid & np.isin(name.view(np.int64), hot))
                    n = np.ones(len(at), np.int64)
                else:
                    new = valid.copy()
                    new[1:] &= (name[1:] != name[:-1]) | ~valid[:-1]
                    new[first[:-1][long]] = True
                    at = np.flatnonzero(new)
                    n = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1 - at
                    parts = -(-n // LONGEST)
                    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    at, n = np.repeat(at, parts) + step * LONGEST, np.minimum(LONGEST, np.repeat(n, parts) - step * LONGEST)
                if not len(at):
                    continue
                content = _spans(words, at, at + n + window - 1)
                doc = np.searchsorted(first, at, "right") - 1
                names = content if hot is not None else name[at]
                cols = [names.view(np.int64), content.view(np.int64), ids[block.first + doc], marks[block.first + doc], (at - first[doc]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "content", "id", "mark", "start", "n"])

    return run


def _windows(window: int):
    """Of rows ``id, mark, text, own`` (segments): each of their windows as a segment named by its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            for block in blocks(batch.column("text")):
                own, doc, start, n = _own(batch, block)
                if not len(own):
                    continue
                begin, end, first = block.words()
                words = block.hashes(begin, end)
                doc = np.repeat(doc, n)
                at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum()) + first[doc]
                content = _spans(words, at, at + window).view(np.int64)
                cols = [content, content, ids[block.first + doc], marks[block.first + doc], (at - first[doc]).astype(np.int32), np.ones(len(at), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["name", "content", "id", "mark", "start", "n"])

    return run


def _own(batch: pa.RecordBatch, block: Block) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments that stand in ``own`` of the block's rows: all fields, the row in the block, start and number of windows."""
    lists = batch.column("own").slice(block.first, block.n)
    own = lists.flatten()
    doc = np.repeat(np.arange(block.n), np.diff(lists.offsets.to_numpy()))
    return own, doc, own.field("start").to_numpy().astype(np.int64), own.field("n").to_numpy().astype(np.int64)


def _cut(window: int):
    """The texts of the segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                own, doc, start, n = _own(batch, block)
                begin, end, first = block.words()
                lo, hi = begin[first[doc] + start], end[first[doc] + start + n + window - 2]
                cut = np.append(0, np.cumsum(hi - lo))
                for a in range(0, len(own), 20_000):
                    b = min(a + 20_000, len(own))
                    data = b"".join(block.buf[x:y].tobytes() for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True))
                    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((cut[a : b + 1] - cut[a]).tobytes()), pa.py_buffer(data)])
                    fields = [own.field(c).slice(a, b - a) for c in ("shard", "name", "content", "least", "kept", "sought")]
                    yield pa.RecordBatch.from_arrays([*fields, text.cast(pa.binary())], ["shard", "name", "content", "least", "kept", "sought", "text"])

    return run


def _search(window: int):
    """One shard: builds its index and streams the segments that are sought. Per segment: runs of windows with the same smallest document, smaller than its own."""

    def run(table: pa.Table) -> pa.Table:
        def words_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            texts = rows.column("text").to_pylist()
            offsets = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)).astype(np.int64)
            block = Block(np.frombuffer(b"".join(texts), np.uint8), offsets, 0)
            start, end, first = block.words()
            return block.hashes(start, end), first

        kept, sought = table.filter(table.column("kept")), table.filter(table.column("sought"))
        index = FMIndex(*words_of(kept), kept.column("least").to_numpy(), window)
        words, first = words_of(sought)
        least = index.matches(words, first)
        n = np.maximum(np.diff(first) - window + 1, 0)
        before = np.cumsum(n) - n
        own = np.repeat(sought.column("least").to_numpy(), n)
        least = np.where(least < own, least, NONE)
        head = np.ones(len(least), bool)
        head[1:] = least[1:] != least[:-1]
        head[before[n > 0]] = True
        at = np.flatnonzero(head)
        text = np.searchsorted(np.cumsum(n), at, "right")
        stop = np.append(at[1:], len(least)) - before[text]
        good = np.flatnonzero(least[at] != NONE)
        at, text, stop = at[good], text[good], stop[good]
        cols = [pa.array(sought.column(c).to_numpy()[text]) for c in ("name", "content")]
        return pa.table([*cols, pa.array((at - before[text]).astype(np.int32)), pa.array(stop.astype(np.int32))], ["name", "content", "begin", "stop"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("from_word", pa.int32()), ("to_word", pa.int32())])
    for batch in batches:
        for block in blocks(batch.column("text")):
            start, end, first = block.words()
            lists = batch.column("gone").slice(block.first, block.n).fill_null([])
            spans, doc = lists.flatten(), np.repeat(np.arange(block.n), np.diff(lists.offsets.to_numpy()))
            edge = np.zeros(len(start) + 1, np.int64)
            np.add.at(edge, first[doc] + spans.field("from").to_numpy(), 1)
            np.add.at(edge, first[doc] + spans.field("to").to_numpy(), -1)
            gone = np.cumsum(edge)[:-1] > 0
            begins, ends = gone.copy(), gone.copy()
            begins[1:] &= ~gone[:-1]
            ends[:-1] &= ~gone[1:]
            begins[first[:-1][first[:-1] < len(gone)]] = gone[first[:-1][first[:-1] < len(gone)]]
            ends[first[1:][first[1:] > 0] - 1] = gone[first[1:][first[1:] > 0] - 1]
            a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            row = np.searchsorted(first, a, "right") - 1
            removed = pa.StructArray.from_arrays([pa.array((a - first[row]).astype(np.int32)), pa.array((b - first[row]).astype(np.int32))], fields=list(kind))
            at = np.searchsorted(row, np.arange(block.n + 1)).astype(np.int32)
            through = np.append(0, np.cumsum(gone))
            n_removed = through[first[1:]] - through[first[:-1]]
            cols = [batch.column("id").slice(block.first, block.n), pa.array(np.diff(first)), pa.array(n_removed), joined_words(block, start, end, first, ~gone), pa.ListArray.from_arrays(pa.array(at), removed)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "n_words", "n_removed", "text", "removed"])


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``id_col, n_words, n_removed, text, removed`` of every row: its words without those that a repeated window covers, and the intervals of the latter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    real = docs.select(F.col(id_col).cast("long").alias("real"), text.alias("text"))
    own = real.select("real", F.coalesce("real", F.lit(_FAR)).alias("id"), "text", F.xxhash64("text").alias("mark"))
    source = own.select("id", "mark", "text")

    def repeated(segments: DataFrame) -> DataFrame:
        """Those whose name more than one document has."""
        names = segments.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("name")
        return segments.join(written(names, "repeated-names"), "name")  # a stored table, so that Spark splits a name that very many segments have

    def distinct(segments: DataFrame) -> DataFrame:
        kinds = segments.groupBy("name", "content").agg(F.min(F.struct("id", "mark", "start", "n")).alias("rep"))
        return written(kinds.select("name", "content", "rep.*"), "distinct-segments")

    def with_text(lists: DataFrame) -> DataFrame:
        """Rows ``id, mark, text, own``; equal rows of one id are one."""
        return source.join(lists, ["id", "mark"]).groupBy("id", "mark").agg(F.first("text").alias("text"), F.first("own").alias("own"))

    shared = written(repeated(written(source.mapInArrow(_segments(window, None), _SEGMENT), "segments")), "shared-segments")
    kinds = distinct(shared)
    many = written(kinds.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("name"), "hot-names")
    if n_hot := many.count():
        if n_hot <= BROADCAST_NAMES:
            names = np.array([r["name"] for r in many.collect()], np.int64)
            windows = source.mapInArrow(_segments(window, names), _SEGMENT)
        else:
            lists = shared.join(many, "name", "left_semi").groupBy("id", "mark").agg(F.collect_set(F.struct("start", "n")).alias("own"))
            windows = with_text(lists).mapInArrow(_windows(window), _SEGMENT)
        shared = written(shared.join(many, "name", "left_anti").unionByName(repeated(windows).select(*shared.columns)), "shared-segments")
        kinds = distinct(shared)
    total = kinds.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    # of a name's segments, by smallest document, the last one needn't be in the index, nor the first one in the stream; at most ``hot`` of them
    by_name = Window.partitionBy("name")
    ranked = kinds.select("*", F.row_number().over(by_name.orderBy("id", "content")).alias("at"), F.count("*").over(by_name).alias("of")).filter("of > 1")
    fields = F.struct(F.pmod(F.xxhash64("name"), F.lit(shards)).alias("shard"), "name", "content", F.col("id").alias("least"), (F.col("at") < F.col("of")).alias("kept"), (F.col("at") > 1).alias("sought"), "start", "n")
    lists = ranked.groupBy("id", "mark").agg(F.collect_list(fields).alias("own"))
    texts = with_text(lists).mapInArrow(_cut(window), "shard long, name long, content long, least long, kept boolean, sought boolean, text binary")
    runs = texts.groupBy("shard").applyInArrow(_search(window), "name long, content long, begin int, stop int")
    least = kinds.select("name", "content", F.col("id").alias("least"))
    all_ = shared.join(least, ["name", "content"])
    whole = all_.filter(F.col("least") < F.col("id")).select("id", "mark", "start", F.lit(0).alias("begin"), F.col("n").alias("stop"))
    parts = all_.filter(F.col("least") == F.col("id")).join(runs, ["name", "content"]).select("id", "mark", "start", "begin", "stop")
    spans = whole.unionByName(parts).select("id", "mark", F.struct((F.col("start") + F.col("begin")).alias("from"), (F.col("start") + F.col("stop") + (window - 1)).alias("to")).alias("span"))
    gone = spans.groupBy("id", "mark").agg(F.collect_set("span").alias("gone"))
    out = own.join(gone, ["id", "mark"], "left").select(F.col("real").alias("id"), "text", "gone").mapInArrow(
        _kept, "id long, n_words long, n_removed long, text string, removed array<struct<from_word: int, to_word: int>>"
    )
    return out if id_col == "id" else out.withColumnRenamed("id", id_col)
