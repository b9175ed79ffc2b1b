"""A training corpus from ``documents``, in five stages: toxic documents go, one of each group of near-duplicates stays, documents
that hold benchmark items go, sources are mixed to their target weights, and the mix is written as token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its caller writes that and reads it again for the next one. What a stage has put
into the shared folder is removed when the next one begins, as its result is stored by then; the last one's tables are removed when the next run begins, or by ``cellmosaic.llm.shared.clear``.

Each stage takes nulls, empty and very long texts, repeated rows and extra columns as its operator's docstring defines, and gives an empty table for an empty one. Null texts are clean, are kept as they are
until the mix, and have no words to be in it. Rows that are equal in id and text count as one from the second stage on, and as several copies only where the mix repeats them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm.decontaminate import contamination
from cellmosaic.llm.mixing import WORD, mix_sources
from cellmosaic.llm.near_dedup import near_duplicates
from cellmosaic.llm.shared import new_path, remove, scope
from cellmosaic.llm.token_output import read_tokens, write_tokens
from cellmosaic.llm.toxicity import fit_toxicity, score_toxicity

TOXIC, SEED = 0.3, 17
_before: list[str] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _before)
        _before.clear()
        with scope() as made:
            out = f(spark, docs, sf_dir)
        _before.extend(made)
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the model learns from the labels of documents that are not held out."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).filter(F.col("score") < TOXIC).select("row.*")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id."""
    kept = near_duplicates(docs, k=5, percent=80, with_mark=True).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark"))
    number = F.col("doc_id").cast("long")
    marked = docs.select(F.struct(*docs.columns).alias("row"), number.alias("id"), F.xxhash64(number, F.coalesce("text", F.lit(""))).alias("mark"))
    same = marked["id"].eqNullSafe(kept["kept_id"]) & (marked["mark"] == kept["kept_mark"])  # of two texts with one hash, only those of one id are taken for one
    return marked.join(kept, same, "left_semi").dropDuplicates(["id", "mark"]).select("row.*")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words in edits."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80, with_row=True)
    return found.filter(F.size("matches") == 0).select("row.*")


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it whole, and the first words of the one that a source's last pass cuts, so that each source gives its target to the word."""
    taken = mix_sources(docs, seed=SEED).taken().filter("taken > 0")
    rest = F.col("taken") % F.col("size")
    takes = taken.groupBy(F.col("id").alias("take_id"), F.col("key").alias("take_key")).agg(F.sum(F.expr("taken div size")).cast("int").alias("copies"), F.collect_list(F.when(rest > 0, rest.cast("int"))).alias("rests"))
    number = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), number.alias("id"), F.xxhash64(F.lit(SEED), number, F.col("text")).alias("key")).dropDuplicates(["id", "key"])
    each = keyed.join(takes, keyed["id"].eqNullSafe(takes["take_id"]) & (keyed["key"] == takes["take_key"])).select("row", F.explode(F.concat(F.array_repeat(F.lit(None).cast("int"), F.col("copies")), "rests")).alias("n"))
    words = F.regexp_extract_all("row.text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    text = F.when(F.col("n").isNull(), F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("n")), ""))
    out = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(F.col("n").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return each.select(out.alias("row")).select("row.*")


@_stage
def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token-id files, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    files = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(files).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token ids", write_token_ids),
]

#: A learnt model, sketches and a tokenizer have no SQL. ``tests/llm`` holds each stage and ``run`` against brute force on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
