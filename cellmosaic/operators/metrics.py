"""Accuracy: paired tables, confusions, scores, purity and information loss. Only sums by class leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmosaic.functions.grid import block_id, is_test
from cellmosaic.functions.stats import mcnemar, purity_band, ratio
from cellmosaic.operators.cells import with_centres

ARMS = ("pred_a5", "pred_a5_transfer", "pred_raster")


def paired_table(cells: DataFrame, raster: DataFrame, stats: DataFrame, transfer: DataFrame | None, level: int, exclude: tuple[int, ...] = ()) -> DataFrame:
    """Cells' predictions (``cell_id, label, pred``), the raster's majority (``cell_id, value``), stats and the transferred predictions (``cell_id, pred``), by cell.

    All join on the cell id, so each input is shuffled once at most. A cell without a transferred prediction has null there.
    Where ``stats`` stores the centres (``lon, lat``), they are taken from there.
    """
    out = cells.withColumnRenamed("pred", "pred_a5").join(raster.select("cell_id", F.col("value").alias("pred_raster")), "cell_id").join(stats, "cell_id")
    if transfer is not None:
        out = out.join(transfer.select("cell_id", F.col("pred").alias("pred_a5_transfer")), "cell_id", "left")
    out = out.filter("label <> 0 and pred_raster <> 0")
    if exclude:
        out = out.filter(~F.col("label").isin(*exclude))
    return out if "lon" in stats.columns else with_centres(out, level)


def with_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``block`` and ``test``."""
    return df.withColumn("block", block_id(F.col("lon"), F.col("lat"))).withColumn("test", is_test(F.col("block"), seed))


def arms(paired: DataFrame, *keep: str) -> DataFrame:
    """One row for each arm's prediction. Null predictions are dropped, from that arm only."""
    stack = ", ".join(f"'{a}', {a}" for a in ARMS)
    return paired.select(*keep, "label", F.expr(f"stack({len(ARMS)}, {stack}) as (arm, pred)")).filter("pred is not null")


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, label, pred, n``."""
    return rows.groupBy(*keys, "label", "pred").agg(F.count("*").alias("n"))


def confusion_normalised(counts: DataFrame) -> DataFrame:
    """Each row's share of its label; sums over nine classes at most."""
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("label"))))


def metrics_per_class(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys, class, user_accuracy, producer_accuracy, f1, support`` over the classes that are observed or predicted."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(none)
    of_label = F.struct(F.col("label").alias("class"), n.alias("support"), hit.alias("hits"), none.alias("said"))
    of_pred = F.struct(F.col("pred").alias("class"), none.alias("support"), none.alias("hits"), n.alias("said"))
    both = counts.select(*keys, F.explode(F.array(of_label, of_pred)).alias("_c")).select(*keys, "_c.*").groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("support", "hits", "said")])
    user, producer = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    return both.select(*keys, "class", user.alias("user_accuracy"), producer.alias("producer_accuracy"), ratio(2 * F.col("hits"), F.col("said") + F.col("support")).alias("f1"), "support", "hits")


def metrics_overall(counts: DataFrame, *keys: str) -> DataFrame:
    """``keys, n_test, overall_accuracy, macro_f1, weighted_f1``."""
    per = metrics_per_class(counts, *keys)
    n = F.sum("support")
    return per.groupBy(*keys).agg(n.alias("n_test"), ratio(F.sum("hits"), n).alias("overall_accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def mcnemar_counts(paired: DataFrame, arm: str = "pred_a5", against: str = "pred_raster") -> DataFrame:
    """``b``: only the arm is right; ``c``: only the other one is; and the statistic."""
    a, r = F.col(arm) == F.col("label"), F.col(against) == F.col("label")
    return paired.agg(F.count_if(a & ~r).alias("b"), F.count_if(~a & r).alias("c")).withColumn("statistic", mcnemar(F.col("b"), F.col("c")))


def info_loss(paired: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """What one value a cell hides, over all cells."""
    cv = F.when(F.abs("b08_mean") > epsilon, F.col("b08_std") / F.col("b08_mean"))
    pure = ratio(F.count_if(F.col("label_purity") >= 1), F.count("*"))
    return paired.agg(F.count("*").alias("n_cells"), F.avg("label_purity").alias("mean_purity"), F.avg("b08_std").alias("mean_b08_std"), F.avg(cv).alias("mean_b08_cv"), pure.alias("pure_fraction"))


def mixed_by_class(paired: DataFrame) -> DataFrame:
    return paired.groupBy("label").agg(F.count("*").alias("n_cells"), ratio(F.count_if(F.col("label_purity") < 1), F.count("*")).alias("mixed_fraction"))


def accuracy_by_purity(test: DataFrame, arm: str = "pred_a5") -> DataFrame:
    right = F.count_if(F.col(arm) == F.col("label"))
    return test.groupBy(purity_band(F.col("label_purity")).alias("band")).agg(F.count("*").alias("n"), right.alias("correct"), ratio(right, F.count("*")).alias("accuracy"))


def audit_high_purity(test: DataFrame, least: float = 0.95) -> DataFrame:
    """Where cells are nearly pure, aggregation can't be to blame: who is right there, the transferred or the raster arm?"""
    t, r = F.coalesce(F.col("pred_a5_transfer") == F.col("label"), F.lit(False)), F.col("pred_raster") == F.col("label")
    own = test.filter(F.col("label_purity") >= least)
    return own.agg(F.count("*").alias("n"), F.count_if(t & r).alias("both"), F.count_if(t & ~r).alias("transfer_only"), F.count_if(~t & r).alias("raster_only"), F.count_if(~t & ~r).alias("neither"))


def audit_samples(test: DataFrame, least: float = 0.95, n: int = 40) -> DataFrame:
    """The first ``n`` nearly pure cells by id that only the transferred arm has right."""
    own = test.filter((F.col("label_purity") >= least) & (F.col("pred_a5_transfer") == F.col("label")) & (F.col("pred_raster") != F.col("label")))
    return own.orderBy("cell_id").limit(n).select("cell_id", "label", "pred_raster", "lon", "lat")


def external_score(paired: DataFrame, prediction: DataFrame, seed: int = 42) -> DataFrame:
    """Scores another file's ``cell_id, label, pred`` on the same test cells."""
    own = with_split(paired, seed).filter("test").select("cell_id").join(prediction, "cell_id")
    return metrics_overall(confusion(own.filter("label <> 0")))


def missing_transfer(test: DataFrame) -> int:
    """Test cells without a transferred prediction; a strict comparison wants 0."""
    return test.filter("pred_a5_transfer is null").count()
