"""Stages of the pipeline on small tables, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mix_gives_each_source_its_target(spark, make):
    """A source of one long document, of which the mix takes less than half, and usual ones, with repeated, null and empty rows."""
    import corpus_pipeline

    rows = [(k, " ".join(f"{s}{k}w{j}" for j in range(10)) + " \n", s) for s in "ab" for k in range(100 * (s == "b"), 100 + 100 * (s == "b"))]
    rows += [(500, "\n".join(f"long\tx{j}" for j in range(500)), "c"), (0, rows[0][1], "a"), (600, None, "a"), (601, "", "b"), (None, None, None), (602, " ", "d")]
    rows += [(None, "one two three four", None)] * 2
    frame = make(rows)
    out = corpus_pipeline.mix(spark, frame, "").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    assert sizes == {"a": 1010, "b": 1000, "c": 1000, "d": 0, None: 8}
    # weights 5, 2, 1, 5, 2 for a, b, c, d, null: the one at its most three times over, the others share the rest
    rest = sum(sizes.values()) - 24
    want = {"a": rest * 5 / 8, "b": rest * 2 / 8, "c": rest / 8, None: 24}
    got, texts, cut = Counter(), {(i, t) for i, t, _ in rows}, defaultdict(list)
    for r in out:
        got[r["source"]] += len(WORD.findall(r["text"]))
        if (r["doc_id"], r["text"]) not in texts:
            cut[r["source"]].append(r)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1 for s in want), (got, want)
    for own in cut.values():
        assert len(own) == 1
        whole = next(t for i, t, _ in rows if i == own[0]["doc_id"])
        assert whole.startswith(own[0]["text"]) and own[0]["n_chars"] == len(own[0]["text"])
    assert cut["c"] and corpus_pipeline.mix(spark, frame.filter(F.lit(False)), "").count() == 0


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def prose(rng, n):
    return " ".join(rng.choice(("ka", "lo", "mi", "ne", "pu", "ra")) + rng.choice(("b", "d", "st", "rr", "n", "x", "gh")) + str(rng.randrange(6)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, make, tmp_path_factory):
    """A small project folder: clean, toxic, copied and contaminated documents, with null, empty and repeated rows."""
    rng = random.Random(8)
    items = [(k, prose(rng, 30)) for k in range(6)]
    rows, labels = [], []
    for k in range(400):
        words = prose(rng, 60).split()
        bad = k % 4 == 0
        if bad:
            words[5:9] = ["scumbag", "idiotic", rng.choice(("scummy", "idiots")), "scum"]
        rows.append((k, " ".join(words), f"s{k % 3}"))
        labels.append((k, int(bad)))
    for k in range(30):  # copies, some with an edit
        words = rows[4 * k + 1][1].split()
        if k % 2:
            words[30] = f"edited{k}"
        rows.append((1000 + k, " ".join(words), "s1"))
    for k in range(20):
        rows.append((2000 + k, prose(rng, 20) + " " + items[k % 6][1] + " " + prose(rng, 20), "s2"))
    rows += [(3000, None, "s0"), (3001, "", None), (None, None, None), (None, prose(rng, 30), "s0"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (5, prose(rng, 40), "s2")]
    d = f"file://{tmp_path_factory.mktemp('project')}"
    make(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return rows, items, d


def test_drop_toxic(spark, corpus):
    """Against a plain loop over n-grams with the same model."""
    import corpus_pipeline
    from cellmosaic.llm.toxicity import fit_toxicity
    from tests.llm.test_registered import plain_score

    rows, _, d = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{d}/labels.parquet"))
    out = corpus_pipeline.drop_toxic(spark, docs, d)
    assert out.columns == docs.columns and rows_of(out, "doc_id", "text") == sorted(((i, t) for i, t, _ in rows if plain_score(model, t) < corpus_pipeline.TOXIC), key=repr)
    gone = {i for i, t, _ in rows if plain_score(model, t) >= corpus_pipeline.TOXIC}
    assert len(gone & {4 * k for k in range(100)}) > 90 and len(gone) < 110


def test_drop_near_duplicates(spark, corpus):
    import corpus_pipeline
    from tests.llm.test_operators import near_oracle

    rows, _, d = corpus
    out = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    kept = {i for i, _, _, keep in near_oracle(rows, 5, 80) if keep}
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t or "")
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    assert len(got) == len(set(got)) and {i for i, _ in got} == kept and not {1000 + k for k in range(30)} & kept
    assert set(got) == {(i, t) for i in kept for t in texts[i]}


def test_drop_contaminated(spark, corpus):
    import corpus_pipeline
    from cellmosaic.llm.decontaminate import _bare_words
    from tests.llm.test_registered import contaminated

    rows, items, d = corpus
    out = corpus_pipeline.drop_contaminated(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    found = contaminated([(i, t) for i, t, _ in rows], list(zip([k for k, _ in items], _bare_words([t for _, t in items]), strict=True)))
    assert rows_of(out, "doc_id", "text") == sorted(((i, t) for (i, t, _), (_, hit) in zip(rows, found, strict=True) if not hit), key=repr)
    assert sum(bool(hit) for _, hit in found) == 20


def token_rows(rows):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=repr)


def test_write_token_ids(spark, corpus):
    import corpus_pipeline

    rows, _, d = corpus
    out = corpus_pipeline.write_token_ids(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert rows_of(out, "doc_id", "n_tokens", "ids_crc32") == token_rows([(i, t) for i, t, _ in rows])


def test_run(spark, corpus, monkeypatch):
    """The stages in their order, each on all that the one before kept; the last one's rows are the library's ids of the mix."""
    import corpus_pipeline

    rows, _, d = corpus
    seen = []

    def noted(name, stage):
        def f(spark, docs, sf_dir):
            seen.append((name, docs.collect()))
            return stage(spark, docs, sf_dir)

        return f

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing", "token ids"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, noted(n, f)) for n, f in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, d)
    given = dict(seen)
    assert rows_of(out, "doc_id", "n_tokens", "ids_crc32") == token_rows([(r["doc_id"], r["text"]) for r in given["token ids"]])
    ids = {n: {r["doc_id"] for r in x} for n, x in seen}
    assert ids["toxicity"] == {i for i, _, _ in rows} and len(ids["toxicity"] - ids["near-duplicates"]) >= 90
    assert not {1000 + k for k in range(30)} & ids["decontamination"] and not {2000 + k for k in range(20)} & ids["mixing"]
    assert ids["token ids"] <= ids["mixing"] <= ids["decontamination"] <= ids["near-duplicates"]


def test_empty_tables(spark, make, tmp_path):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    make([]).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
