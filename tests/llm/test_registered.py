"""The registered queries on the smallest tables, against brute force where SQL can't express them."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("id", "v", "h1", "row", "mark", "list", "words", "matches", "key", "digest", "bytes", "y", "score", "text_", "n")


@pytest.fixture(scope="module", autouse=True)
def data():
    if not os.path.isdir(DIR):
        pytest.skip("no test data here")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def run(spark, name):
    from cellmosaic.llm.queries import queries

    return queries()[name](spark, DIR)


def words_of(text):
    return WORD.findall(text or "")


def test_all_are_registered():
    import __spark_entry__
    from cellmosaic.llm.queries import oracle_sql, queries

    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(queries()) | {"pipeline"} <= set(__spark_entry__.queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_minhash", "op6_substring_dedup", "op10_warc"])
def test_against_sql(spark, name):
    import duckdb

    from cellmosaic.llm.queries import oracle_sql

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = con.sql(oracle_sql()[name]), run(spark, name)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda columns, rs: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rs)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_op3(spark):
    own = {r["vec_id"]: r for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    x = {i: np.array(r["embedding"], float) for i, r in own.items() if r["embedding"] is not None and None not in r["embedding"]}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids = np.array(sorted(x))
    flat = np.stack([x[i] for i in ids])
    norm = np.linalg.norm(flat, axis=1)
    got = defaultdict(list)
    for r in run(spark, "op3_neighbours").orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        score = flat @ x[q] / (norm * np.linalg.norm(x[q]))
        score[ids == q] = -9
        best = ids[np.lexsort((ids, -score.round(12)))[:5]]
        hit, total = hit + len(set(best) & {r["vec_id"] for r in got[q]}), total + len(best)
        assert [r["rank"] for r in got[q]] == list(range(1, len(best) + 1))
        assert all(r["score"] == pytest.approx(score[ids == r["vec_id"]][0], abs=1e-12) for r in got[q])
    assert set(got) == set(ids[ids % 50 == 0]) and hit >= 0.95 * total


def test_op4(spark, documents):
    from cellmosaic.llm.mixing import source_targets

    out = {r["doc_id"]: r for r in run(spark, "op4_mixing").collect()}
    names = sorted({r["source"] for r in documents.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words_of(r["text"])) for r in documents.values() if r["source"] == s) for s in names]
    target = source_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    for s, n, t in zip(names, sizes, target, strict=True):
        own = [out[i] for i, r in documents.items() if r["source"] == s]
        assert all(r["source_size"] == n and r["target"] == pytest.approx(t) and r["taken"] <= 3 * r["size"] for r in own) and abs(sum(r["taken"] for r in own) - t) <= 1
    assert all(out[i]["size"] == len(words_of(r["text"])) for i, r in documents.items())


def contaminated(documents, items, percent=80):
    """By id: the items within a fifth of their words in edits, from the whole table of distances of each pair."""
    from cellmosaic.llm.decontaminate import _bare_words, best_match

    words = _bare_words([t for _, t in documents])
    found = []
    for (i, _), text in zip(documents, words, strict=True):
        own = set()
        for item, w in items:
            if len(w) and len(text) and np.isin(w, text).sum() >= len(w) - len(w) * (100 - percent) // 100 and best_match(w, text)[0] <= len(w) * (100 - percent) // 100:
                own.add(item)
        found.append((i, sorted(own)))
    return found


def test_op5(spark, documents):
    from cellmosaic.llm.decontaminate import _bare_words

    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    items = list(zip([r["item_id"] for r in bench], _bare_words([r["text"] for r in bench]), strict=True))
    want = dict(contaminated([(i, r["text"]) for i, r in documents.items()], items))
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in run(spark, "op5_decontamination").collect()}
    assert got == {i: (bool(x), x) for i, x in want.items()} and any(want.values())


def test_op7(spark, documents):
    from tokenizers import Tokenizer

    library, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(documents):
        ids = library.encode(documents[i]["text"] or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, run(spark, "op7_token_output").select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


MASK = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def plain_score(model, text):
    """A loop over distinct words and their n-grams."""
    from cellmosaic.llm.toxicity import BUCKETS, GRAMS, NEUTRAL

    total = n = 0
    for word in {re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())}:
        marked = b"<" + word + b">"
        features = [plain_mix(sum(plain_mix(b + 257 * k & MASK) for k, b in enumerate(marked)) & MASK)]
        for size in GRAMS:
            for k in range(len(marked) - size + 1):
                h = 0
                for b in marked[k : k + size]:
                    h = (h * 0x100000001B3 + b + 1) & MASK
                features.append(plain_mix(h + size - 1 & MASK))
        total += sum(model.weights[f & BUCKETS - 1] for f in features)
        n += len(features)
    return 1 / (1 + np.exp(-(model.bias + total / (n + NEUTRAL))))


def test_op8(spark, documents):
    from cellmosaic.llm.toxicity import fit_toxicity

    model = fit_toxicity(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    out = run(spark, "op8_toxicity").collect()
    assert len(out) == len(documents) and np.abs(model.weights).sum() > 0
    for r in out:
        assert r["score"] == pytest.approx(plain_score(model, documents[r["doc_id"]]["text"]), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3)


def test_fit_is_bounded_in_bytes(spark, make):
    """A text that doesn't fit is passed over; different texts with one id count once."""
    from cellmosaic.llm import toxicity

    rows = [(k, f"good{k} plain words here", "a") for k in range(40)] + [(40 + k, f"bad{k} scum words here", "a") for k in range(40)] + [(99, "huge " * 10_000, "a"), (3, "another text", "a")]
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(80)] + [(99, 1)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda texts, y, share: seen.append(texts.to_pylist()) or train(texts, y, share)
        toxicity.fit_toxicity(make(rows), labels, most_bytes=1000)
        toxicity.fit_toxicity(make(rows), labels)
    finally:
        toxicity.train = train
    assert 800 < sum(map(len, seen[0])) <= 1000 and not any(t.startswith("huge") for t in seen[0])
    assert len(seen[1]) == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in [*range(80), 99])


def test_op9(spark, documents):
    from cellmosaic.llm.token_counts import has_bytes, load_vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    first, later = map(set, load_vocabulary(path))
    pieces = {"▁" + p for p in first} | later
    assert has_bytes(path)
    longest, memo = max(map(len, pieces)), {}

    def greedy(word):
        if word not in memo:
            text, k, n = "▁" + word, 0, 0
            while k < len(text):
                end = next((j for j in range(min(len(text), k + longest), k, -1) if text[k:j] in pieces), None)
                k, n = (end, n + 1) if end else (k + 1, n + len(text[k].encode()))
            memo[word] = n
        return memo[word]

    want = sorted((i, len(words_of(r["text"])), sum(map(greedy, words_of(r["text"])))) for i, r in documents.items())
    assert sorted(map(tuple, run(spark, "op9_token_counts").select("doc_id", "n_words", "n_tokens").collect())) == want


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """On the tables besides documents: the same rows as without them."""
    from cellmosaic.llm import queries as q

    for name in ("embeddings", "pages", "labels", "benchmark", "documents"):
        own = spark.read.parquet(f"{DIR}/{name}.parquet")
        for c in CLASH:
            if c not in own.columns:
                own = own.withColumn(c, F.lit("x"))
        own.write.parquet(f"file://{tmp_path}/{name}.parquet")
    for name in ("op3_neighbours", "op5_decontamination", "op8_toxicity", "op10_warc"):
        want, got = (sorted(map(repr, q.queries()[name](spark, d).collect())) for d in (DIR, f"file://{tmp_path}"))
        assert want == got, name


def test_vectors_whose_squares_leave_the_range(spark):
    from cellmosaic.llm.ann import nearest

    rows = [(0, [3e200, 4e200]), (1, [4.0, 3.0]), (2, [3e-200, 4e-200]), (3, [-1.0, 0.0])]
    got = [(r["vec_id"], r["score"]) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 3).orderBy("rank").collect()]
    assert [i for i, _ in got] == [2, 1, 3] and [s for _, s in got] == pytest.approx([1.0, 0.96, -0.6])


def test_crowded_bucket_stays_in_proportion(make, monkeypatch):
    """Pages alike in a common part, but not similar enough: rows made in their comparison grow no faster than pages. Chains among them are found."""
    import random

    from cellmosaic.llm import near_dedup

    rng = random.Random(1)
    monkeypatch.setattr(near_dedup, "GROUP", 50)
    common = " ".join(f"c{k}" for k in range(150))
    made, grown = {}, []
    stored = near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name: made.__setitem__(name, (out := stored(df, name)).count()) or out)
    for n in (300, 900):
        rows = [(k, common + " " + " ".join(f"u{k}x{j}" for j in range(60)), "a") for k in range(n)]  # similarity 0.56
        chain = [f"z{j}" for j in range(200)]
        for k in range(6):  # each like the next one only
            rows.append((10_000 + k, common + " " + " ".join(chain), "a"))
            for j in rng.sample(range(200), 8):  # similarity 0.83 or more; two steps on below 0.8
                chain[j] = f"y{k}x{j}"
        out = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make(rows), 4).collect()}
        assert all(out[k] == k for k in range(n)) and {out[10_000 + k] for k in range(6)} == {10_000}
        grown.append((made["prefixes"], made["plausible"]))
    assert all(0 < few and many <= 3 * few for few, many in zip(*grown, strict=True)), grown  # three times the pages
