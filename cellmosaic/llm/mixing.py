"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents stand in a shuffled order (by a seeded hash) and are cut into blocks of ``block_tokens`` words; its
last block is shorter. The mix is a row of slots: slot ``i`` goes to the source at the golden-ratio point ``frac((i + 1/2) phi)`` of the
sources' cumulative shares, and a source's ``k``-th slot takes its ``k``-th block, round and round. A source's slots
past its target go, missing ones are added at the end, and its last slot is cut, so that each source gives its target to the word.

Word positions come from two-level running sums: a source's documents lie in buckets of their hash, about ``BUCKET_ROWS`` in each however large the source, so no task holds a whole source. A chunk of the
schedule has ``CHUNK`` slots, so what one source has in it is bounded too.
To the driver goes one row a source; ``max_sources`` bounds it.

Defined results: a null or wordless text has size 0, is in no slot and takes 0 words. Null is a source of its own, the last one.
Repeated rows are documents of their own, and so are rows with a null id. An empty table gives an empty mix. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmosaic.llm.shared import written

BUCKET_ROWS, CHUNK = 4096, 4096
PHI = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: list[int], weights: list[float], max_repeats: float) -> list[float]:
    """Shares of all words by weight, each at most ``max_repeats`` times the source's size; excess is reshared by weight until none is above."""
    target, rest = [0.0] * len(sizes), sum(sizes)
    share = {k for k, n in enumerate(sizes) if n}
    target_of = dict.fromkeys(range(len(sizes)), 0.0)
    while share:
        total = sum(weights[k] for k in share)
        target_of |= {k: rest * weights[k] / total for k in share}
        above = {k for k in share if target_of[k] > max_repeats * sizes[k]}
        if not above:
            break
        for k in above:
            target_of[k] = float(max_repeats * sizes[k])
            rest -= max_repeats * sizes[k]
        share -= above
    for k, x in target_of.items():
        target[k] = float(x)
    return target


@dataclass
class Mix:
    """``documents``: ``row, key, id, src, size, source_size, target`` (``key``: ``xxhash64`` of seed, id and text); ``slots``: ``slot, src, block, lo, hi`` (words of the block that it takes);
    ``parts``: ``src, block, row, lo, hi, at`` (a document's words in a block; ``at``: number of the first one in the document)."""

    documents: DataFrame
    slots: DataFrame
    parts: DataFrame

    def pieces(self) -> DataFrame:
        """The mix, ``slot, row, from_word, to_word``: slots in order, and the words of each document that stand in them."""
        slots, parts = self.slots.withColumnsRenamed({"lo": "s_lo", "hi": "s_hi"}), self.parts
        lo, hi = F.greatest("lo", "s_lo"), F.least("hi", "s_hi")
        start = F.col("at") - F.col("lo")
        return slots.join(parts, ["src", "block"]).filter(lo < hi).select("slot", "row", (start + lo).alias("from_word"), (start + hi).alias("to_word"))

    def taken(self) -> DataFrame:
        """``row, key, id, size, source_size, target, taken`` of every document."""
        taken = self.pieces().groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
        return self.documents.join(taken, "row", "left").select("row", "key", "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _schedule(spark: SparkSession, needs: list[int]) -> DataFrame:
    """``slot, src, rank``: each source has ``needs`` slots, ranked from 0, spread evenly over all slots."""
    n = sum(needs)
    edges = [float(Fraction(sum(needs[: k + 1]), max(1, n))) for k in range(len(needs))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            at = (slot + 0.5) * PHI
            src = np.minimum(np.searchsorted(np.array(edges), at - np.floor(at), "right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(src.astype(np.int32))], ["slot", "src"])

    drawn = spark.range(n).mapInArrow(draw, "slot long, src int").withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = drawn.join(before.drop("n"), ["src", "chunk"]).select(
        "slot", "src", (F.col("before") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).alias("rank")
    )
    given = dict(counts.groupBy("src").agg(F.sum("n")).collect()) if n else {}
    late = [(k, r) for k, need in enumerate(needs) for r in range(given.get(k, 0), need)]
    end = spark.createDataFrame([(n + i, k, r) for i, (k, r) in enumerate(late)], "slot long, src int, rank long")
    limit = spark.createDataFrame(list(enumerate(needs)), "src int, need long")
    return ranked.unionByName(end).join(limit, "src").filter("rank < need").select("slot", "src", "rank")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, block_tokens: int | None = None, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 1_000_000,
) -> Mix:
    """Plans a mix as large as ``docs``. Sources by code point, null last, weigh ``weights``, repeated as needed.

    ``block_tokens``: words of a block; by default 1/65,536 of all words, 1 to 8,192.
    """
    spark = docs.sparkSession
    sized = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("key"),
        ),
        "mix-sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    target = source_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], max_repeats)
    block = block_tokens or min(8192, max(1, sum(sizes) // 65_536))
    rows, needs = [], []
    for k, r in enumerate(found):
        words = min(round(target[k]), max_repeats * sizes[k])
        whole, rest = divmod(words, sizes[k]) if sizes[k] else (0, 0)
        blocks = -(-sizes[k] // block)
        needs.append(whole * blocks + -(-rest // block))
        bits = max(1, (r["n"] // BUCKET_ROWS).bit_length())
        rows.append((k, r["source"], sizes[k], target[k], blocks, whole, rest, 64 - bits))
    sources = spark.createDataFrame(rows, "src int, name string, source_size long, target double, blocks long, whole long, rest long, shift int")
    own = sized.join(sources.select("src", "name", "source_size", "target", "shift"), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    own = own.withColumn("bucket", F.expr("shiftrightunsigned(key, shift)")).drop("shift")
    sums = own.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("key", "id", "row").rowsBetween(Window.unboundedPreceding, 0))
    placed = own.filter("size > 0").withColumn("through", inside).join(sums.drop("words"), ["src", "bucket"]).withColumn("start", F.col("before") + F.col("through") - F.col("size"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    at = F.greatest("start", F.col("block") * block)
    parts = placed.withColumn("block", F.explode(F.sequence(first, last))).select(
        "src", "block", "row", (at - F.col("block") * block).alias("lo"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("block") * block).alias("hi"), (at - F.col("start")).alias("at"),
    )
    slots = _schedule(spark, needs).join(sources.select("src", "blocks", "whole", "rest", "source_size"), "src")
    slots = slots.withColumn("block", F.expr("rank % blocks")).withColumn("end", F.when(F.floor(F.col("rank") / F.col("blocks")) < F.col("whole"), F.col("source_size")).otherwise(F.col("rest")))
    slots = slots.select("slot", "src", "block", F.lit(0).cast("long").alias("lo"), F.least(F.lit(block).cast("long"), F.col("end") - F.col("block") * block).alias("hi"))
    return Mix(own.select("row", "key", "id", "src", "size", "source_size", "target"), slots, parts)
