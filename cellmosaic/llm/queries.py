"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.llm.ann import nearest
from cellmosaic.llm.decontaminate import contamination
from cellmosaic.llm.line_dedup import line_dedup
from cellmosaic.llm.mixing import mix_sources
from cellmosaic.llm.near_dedup import near_duplicates
from cellmosaic.llm.substring_dedup import substring_dedup
from cellmosaic.llm.token_counts import token_counts
from cellmosaic.llm.token_output import read_tokens, write_tokens
from cellmosaic.llm.toxicity import fit_toxicity, held_out, score_toxicity
from cellmosaic.llm.warc import read_warc, write_index, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"), min_docs=10, keep="none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_OP1 = """
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone ON k.key = gone.key GROUP BY k.doc_id
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=4, percent=80)


_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(x) < 4 THEN array_to_string(x, ' ') ELSE array_to_string(x[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, x, unnest(generate_series(1, greatest(len(x) - 3, 1))) AS i FROM w WHERE len(x) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents")).taken()
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=80)
    items = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    return out.select(F.col("id").alias("doc_id"), (F.size("matches") > 0).alias("contaminated"), items.alias("item_ids"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_OP6 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(x[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) - 49)) AS i FROM w WHERE len(x) >= 50)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
s AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM g JOIN m ON g.h = m.h WHERE least < doc_id),
k AS (SELECT doc_id, i, word FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS word FROM w) ANTI JOIN s USING (doc_id, i)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT w.doc_id, len(x) AS n_words, len(x) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(files).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = write_warc(_table(spark, sf_dir, "pages"), min_bytes=1000)
    return read_warc(write_index(captures)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, cast(strlen(coalesce(html, '')) AS bigint) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT html, max(page_id) AS most FROM p WHERE payload_bytes >= 1000 GROUP BY html)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < most THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < most THEN most END AS refers_to
FROM p LEFT JOIN m ON p.html = m.html
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_minhash": op2_minhash,
        "op3_neighbours": op3_neighbours,
        "op4_mixing": op4_mixing,
        "op5_decontamination": op5_decontamination,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_token_output": op7_token_output,
        "op8_toxicity": op8_toxicity,
        "op9_token_counts": op9_token_counts,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op2_minhash": _OP2, "op6_substring_dedup": _OP6, "op10_warc": _OP10}
