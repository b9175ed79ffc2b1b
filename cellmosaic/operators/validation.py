"""Spatial-block bootstrap: confusions by block and sums of each draw are made by Spark; the driver gets the draws' confusions.

A draw takes as many blocks as there are, with repeats, by NumPy's generator with a seed. Every task draws the same numbers again, one draw at a time, and sums up its own blocks' rows, so no task and no
driver holds a row for each block and draw. To the driver come the sums: a row for each draw, arm, label and prediction that occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmosaic.operators.metrics import ARMS, arms, confusion


def block_confusion(test: DataFrame) -> DataFrame:
    """``block, arm, label, pred, n``."""
    return confusion(arms(test, "block"), "block", "arm")


def scores(counts: np.ndarray) -> np.ndarray:
    """Overall accuracy, macro F1 and weighted F1 of confusions ``[..., observed, predicted]``; zeros without counts."""
    total, hit = counts.sum((-1, -2)), np.diagonal(counts, axis1=-2, axis2=-1)
    seen, said = counts.sum(-1), counts.sum(-2)
    f1 = np.divide(2 * hit, seen + said, out=np.zeros(hit.shape), where=seen + said > 0)
    classes = np.maximum(((seen + said) > 0).sum(-1), 1)
    share = np.divide(seen, total[..., None], out=np.zeros(hit.shape), where=total[..., None] > 0)
    accuracy = np.divide(hit.sum(-1), total, out=np.zeros(total.shape), where=total > 0)
    return np.stack([accuracy, f1.sum(-1) / classes, (f1 * share).sum(-1)], -1)


def numbered(blocks: DataFrame) -> DataFrame:
    """``block`` with ``number``, its place in the order of all, from 0. Two steps: places inside a range of blocks, and how many come before it."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows))], ["block", "part", "at"])
            n += batch.num_rows

    placed = blocks.select(F.col("block").cast("long")).distinct().repartitionByRange("block").sortWithinPartitions("block").mapInArrow(inside, "block long, part int, at long").persist()
    sizes = sorted(placed.groupBy("part").count().collect())  # a row a task
    before = blocks.sparkSession.createDataFrame([(part, sum(n for p, n in sizes if p < part)) for part, _ in sizes], "part int, before long")
    return placed.join(F.broadcast(before), "part").select("block", (F.col("before") + F.col("at")).alias("number"))


def _draws(n_blocks: int, n_boot: int, seed: int):
    """Sums of one task's blocks over each draw; draw -1 has every block once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        kind = table.select(["arm", "label", "pred"]).to_pandas()
        code, kinds = kind.groupby(["arm", "label", "pred"]).ngroup().to_numpy(), kind.drop_duplicates().sort_values(["arm", "label", "pred"])
        number, n = table.column("number").to_numpy(), table.column("n").to_numpy()
        rng = np.random.default_rng(seed)
        for draw in range(-1, n_boot):
            times = np.ones(n_blocks, np.int64) if draw < 0 else np.bincount(rng.integers(0, n_blocks, n_blocks), minlength=n_blocks)
            total = np.bincount(code, times[number] * n, len(kinds)).astype(np.int64)
            cols = [pa.array(np.full(len(kinds), draw, np.int32)), *(pa.array(kinds[c].to_numpy()) for c in ("arm", "label", "pred")), pa.array(total)]
            yield pa.RecordBatch.from_arrays(cols, ["draw", "arm", "label", "pred", "n"])

    return run


def bootstrap(per_block: DataFrame, n_boot: int = 1000, seed: int = 42, of: tuple[str, ...] = ARMS, against: str | None = ARMS[-1]) -> list[dict]:
    """95 % intervals of each arm's scores, and of their differences from those of the arm ``against``. Classes are those that occur; other arms than ``of`` are left out."""
    numbers = numbered(per_block)
    n_blocks = numbers.count()
    if not n_blocks:
        return []
    rows = per_block.filter(F.col("arm").isin(*of)).join(numbers, "block").select("number", "arm", F.col("label").cast("int").alias("label"), F.col("pred").cast("int").alias("pred"), F.col("n").cast("long").alias("n"))
    sums = rows.mapInArrow(_draws(n_blocks, n_boot, seed), "draw int, arm string, label int, pred int, n long").groupBy("draw", "arm", "label", "pred").agg(F.sum("n").alias("n")).toPandas()
    classes = np.unique(np.concatenate([sums["label"], sums["pred"]]))
    tensor = np.zeros((n_boot + 1, len(of), len(classes), len(classes)))
    at = (sums["draw"] + 1, sums["arm"].map({a: k for k, a in enumerate(of)}), np.searchsorted(classes, sums["label"]), np.searchsorted(classes, sums["pred"]))
    tensor[tuple(np.asarray(x) for x in at)] = sums["n"]
    found = scores(tensor)  # draw, arm, metric; the first draw is the table itself
    out = []
    for a, arm in enumerate(of):
        for m, metric in enumerate(("overall_accuracy", "macro_f1", "weighted_f1")):
            kinds = [("score", found[:, a, m])] + ([("difference", found[:, a, m] - found[:, of.index(against), m])] if against else [])
            for kind, values in kinds:
                lo, hi = np.quantile(values[1:], [0.025, 0.975])
                out.append({"arm": arm, "metric": metric, "kind": kind, "point": float(values[0]), "low": float(lo), "high": float(hi)})
    return out


def pixel_bootstrap(sample: DataFrame, n_boot: int = 1000, seed: int = 42) -> list[dict]:
    """The same for a pixel sample's predictions: ``block, label, pred``, a row a pixel."""
    return bootstrap(confusion(sample.withColumn("arm", F.lit("pixels")), "block", "arm"), n_boot, seed, ("pixels",), None)


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.025, 0.975)) -> DataFrame:
    """Exact quantiles, interpolated."""
    return df.agg(F.percentile(column, F.array(*[F.lit(x) for x in at])).alias("q")).select(*[F.col("q")[k].alias(f"q{k}") for k in range(len(at))])
