"""Line dedup: sorted line hashes, streamed once; the result is a compressed keep bitmap per document.

Every line gets a key (white space stripped, A-Z lower-cased) and the key a 128-bit hash. Hash, document and
position are range-partitioned on (hash, document), so that a line that stands in a third of all documents
still spreads over many partitions, and each sorted partition is streamed once. Only runs that touch a
partition's edge can go on in the next one: their counts, two rows a partition at most, are added up afterwards.
No text is shuffled until bitmaps meet their documents.

Defined results: a null text is an empty one, which has one empty line. Lines with an empty key always stay.
Documents are told apart by their id, null being one id; rows with equal id and equal text get the same bitmap, and rows
with equal id and different texts count as one document but keep bitmaps of their own.
An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.llm.shared import written

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "id long, mark long, pos int, h1 long, h2 long, n long, kind int, first boolean, part int"
_DROP, _PENDING, _EDGE = 0, 1, 2


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))


def _runs(min_docs: int, keep_first: bool):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict[str, np.ndarray]] = []  # rows of the run that is open, until it is decided
        run = {"key": None, "docs": 0, "last": None, "head": True, "first_done": False}

        def rows(c, kind, n, first):
            k = len(c["pos"])
            return pa.RecordBatch.from_arrays(
                [pa.array(c["id"], mask=c["null"]), pa.array(c["mark"]), pa.array(c["pos"].astype(np.int32)), pa.array(c["h1"]), pa.array(c["h2"]), pa.array(np.full(k, n)), pa.array(np.full(k, kind, np.int32)), pa.array(first), pa.array(np.full(k, part, np.int32))],
                ["id", "mark", "pos", "h1", "h2", "n", "kind", "first", "part"],
            )

        def out(c, kind, n=0):
            """Rows of one run, or of whole runs inside the partition (first occurrences already gone)."""
            first = np.zeros(len(c["pos"]), bool)
            if keep_first and not run["first_done"]:
                first[0] = run["first_done"] = True
                if not run["head"] and kind == _DROP:  # no earlier partition has this run: its first line stays
                    c, first = {k: v[1:] for k, v in c.items()}, first[1:]
            if len(c["pos"]):
                yield rows(c, kind, n, first)

        def close(tail: bool):
            edge = run["head"] or tail
            if run["key"] is not None:
                for c in held:
                    if edge:
                        yield from out(c, _PENDING, run["docs"])
                if edge:
                    one = {"id": np.zeros(1, np.int64), "null": np.ones(1, bool), "mark": np.zeros(1, np.int64), "pos": np.zeros(1, np.int64), "h1": np.array([run["key"][0]]), "h2": np.array([run["key"][1]])}
                    yield rows(one, _EDGE, run["docs"], np.zeros(1, bool))
            held.clear()

        for batch in batches:
            ids = batch.column(0)
            c = {
                "null": ids.is_null().to_numpy(zero_copy_only=False), "id": ids.fill_null(0).to_numpy(), "mark": batch.column(1).to_numpy(),
                "pos": batch.column(2).to_numpy().astype(np.int64), "h1": batch.column(3).to_numpy(), "h2": batch.column(4).to_numpy(),
            }
            n = len(c["pos"])
            if not n:
                continue
            new_run = np.ones(n, bool)
            new_run[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (c["id"][1:] != c["id"][:-1]) | (c["null"][1:] != c["null"][:-1])
            starts = np.append(np.flatnonzero(new_run), n)
            docs = np.add.reduceat(new_doc.astype(np.int64), starts[:-1])
            lo = 0
            # the run that is open, if it goes on in this batch
            if run["key"] == (c["h1"][0], c["h2"][0]):
                lo, more = 1, int(docs[0]) - int((c["id"][0], c["null"][0]) == run["last"])
            else:
                yield from close(False)
                run |= {"head": run["key"] is None, "key": (c["h1"][0], c["h2"][0]), "docs": 0, "first_done": False}
                lo, more = 1, int(docs[0])
            piece = {k: v[: starts[1]] for k, v in c.items()}
            run["docs"] += more
            if run["docs"] >= min_docs:
                for x in held:
                    yield from out(x, _DROP)
                held.clear()
                yield from out(piece, _DROP)
            else:
                held.append({k: v.copy() for k, v in piece.items()})
            if len(starts) > 2:
                yield from close(False)
                # runs that begin and end in this batch, and not at the partition's edge
                whole = np.repeat((docs[lo:-1] >= min_docs), np.diff(starts)[lo:-1])
                a, b = starts[lo], starts[-2]
                if keep_first:
                    whole &= ~new_run[a:b]
                if whole.any():
                    run["first_done"] = True
                    yield from out({k: v[a:b][whole] for k, v in c.items()}, _DROP)
                run |= {"head": False, "key": (c["h1"][b], c["h2"][b]), "docs": int(docs[-1]), "first_done": False}
                piece = {k: v[b:] for k, v in c.items()}
                if run["docs"] >= min_docs:
                    yield from out(piece, _DROP)
                else:
                    held.append({k: v.copy() for k, v in piece.items()})
            run["last"] = (c["id"][-1], c["null"][-1])
        yield from close(True)

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, counts = [], []
        for at in batch.column("at"):
            at = at.values.to_numpy(zero_copy_only=False)
            keep = np.ones(-(-(int(at.max()) + 1) // 8) * 8, bool)
            keep[at] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            counts.append(int((~keep).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["id", "mark", "n_dropped", "keep_bitmap"])


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 2, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, n_dropped, keep_bitmap`` of every document that loses a line.

    Lines whose key stands in ``min_docs`` documents or more go: all of them (``keep="none"``), or all but the one with
    the smallest document and position (``keep="first"``). ``mark`` is the hash of the text. ``keep_bitmap`` is zlib over
    one bit a line, first line in the highest bit, 1 to keep; it ends with the last line that goes, later ones stay.
    """
    if keep not in ("first", "none") or min_docs < 1:
        raise ValueError("keep is 'first' or 'none', min_docs 1 or more")
    key = F.translate(F.btrim(F.col("line"), F.lit(SPACES)), UPPER, LOWER)
    lines = (
        _source(docs, id_col, text_col)
        .select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "mark", "pos", key.alias("key"))
        .filter(F.length("key") > 0)
        .select("id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    # the bounds of the ranges come from a pass over hashes that are stored: lines are split and hashed once
    found = written(
        written(lines, "line-hashes").repartitionByRange("h1", "h2", "id")
        .sortWithinPartitions("h1", "h2", "id", "mark", "pos")
        .mapInArrow(_runs(min_docs, keep == "first"), _FOUND),
        "line-runs",
    )
    edges = F.broadcast(  # two rows a partition at most
        found.filter(f"kind = {_EDGE}").groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min("part").alias("from"))
    )
    sure = found.filter(f"kind = {_DROP} and not first").select("id", "mark", "pos")
    rest = (
        found.filter(f"kind = {_PENDING} or (kind = {_DROP} and first)")
        .join(edges, ["h1", "h2"])
        .filter((F.col("docs") >= min_docs) & ~(F.col("first") & (F.col("part") == F.col("from"))))
        .select("id", "mark", "pos")
    )
    return sure.unionByName(rest).groupBy("id", "mark").agg(F.collect_set("pos").alias("at")).mapInArrow(_bitmaps, "id long, mark long, n_dropped long, keep_bitmap binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, packed in zip(batch.column("text"), batch.column("keep_bitmap"), strict=True):
            lines = text.as_py().split("\n")
            n = len(lines)
            if packed.is_valid:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed.as_py()), np.uint8))[:n]
                lines = [x for x, b in zip(lines, bits, strict=False) if b] + lines[len(bits) :]
            n_lines.append(n)
            n_dropped.append(n - len(lines))
            kept.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "text"])


def line_dedup(docs: DataFrame, min_docs: int = 2, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_lines, n_dropped, text``: every row of ``docs`` with the lines that ``line_keep_bitmaps`` keeps."""
    gone = line_keep_bitmaps(docs, min_docs, keep, id_col, text_col).select(F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark"), "keep_bitmap")
    own = _source(docs, id_col, text_col)
    both = own.join(gone, own["id"].eqNullSafe(gone["gone_id"]) & (own["mark"] == gone["gone_mark"]), "left")
    out = both.select("id", "text", "keep_bitmap").mapInArrow(_kept, "id long, n_lines long, n_dropped long, text string")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
