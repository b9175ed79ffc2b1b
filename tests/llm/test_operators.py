"""Each operator against brute force on small tables, with odd and empty inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("b", "d", "st", "rr", "n", "x", "gh")]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(make):
    base = [prose(rng.randint(60, 160)) for _ in range(25)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 1, 2, 12))):
            words[rng.randrange(len(words))] = "edited" + str(rng.randrange(99))
        rows.append((100 + k, " ".join(words), "s1"))
    passage = prose(70)
    rows += [(300 + k, prose(20) + "\n" + passage + "\n" + prose(20), None) for k in range(6)]
    rows += [(400 + k, "Common  line\n" + prose(9) + "\n\n common line ", "s2") for k in range(5)]
    return rows, make(rows)


def lines_oracle(rows, least, keep):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\f\r"))
    at, first = defaultdict(set), {}
    for i, t in sorted(((i, t or "") for i, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        for p, x in enumerate(t.split("\n")):
            at[key(x)].add(i)
            first.setdefault(key(x), (i, p))
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        left = [x for p, x in enumerate(lines) if not key(x) or len(at[key(x)]) < least or (keep == "first" and first[key(x)] == (i, p))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "keep"), [(2, "first"), (3, "none"), (1, "first")])
def test_line_dedup(corpus, least, keep):
    from cellmosaic.llm.line_dedup import line_dedup

    rows, docs = corpus
    for parts in (1, 7):
        out = line_dedup(docs.repartition(parts), least, keep)
        assert rows_of(out, "doc_id", "n_lines", "n_dropped", "text") == lines_oracle(rows, least, keep)


def test_line_runs_over_many_batches(spark, make):
    from cellmosaic.llm.line_dedup import line_dedup

    rows = [(k, f"hot\nown {k}\nhot", "a") for k in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for keep in ("first", "none"):
            assert rows_of(line_dedup(make(rows), 10, keep), "doc_id", "n_lines", "n_dropped", "text") == lines_oracle(rows, 10, keep)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def near_oracle(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                comp[root(a)] = root(b)
    least = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(sets[x]), least.get(root(x)), i == least.get(root(x))) for x, (i, _, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(corpus, k):
    from cellmosaic.llm.near_dedup import near_duplicates

    rows, docs = corpus
    assert rows_of(near_duplicates(docs, k), "doc_id", "n_shingles", "component_id", "kept") == near_oracle(rows, k, 80)


def test_near_duplicates_of_one_large_group(make, monkeypatch):
    from cellmosaic.llm import near_dedup

    monkeypatch.setattr(near_dedup, "GROUP", 20)
    base = prose(80).split()
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(999)}"
        rows.append((k, " ".join(words), "a"))
    out = near_dedup.near_duplicates(make(rows), 4)
    assert rows_of(out, "doc_id", "n_shingles", "component_id", "kept") == near_oracle(rows, 4, 80)


def test_sketch_fills_and_estimates():
    from cellmosaic.llm.near_dedup import BINS, sketch

    g = np.random.default_rng(1)
    a = np.unique(g.integers(1, 1 << 62, 3000, dtype=np.uint64))
    off = []
    for share in (0.5, 0.8, 0.95):
        n = int(len(a) * (1 - share) / (1 + share))
        b = np.concatenate([a[n:], g.integers(1, 1 << 62, n, dtype=np.uint64)])
        s = sketch(np.concatenate([a, b, a[:1]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
        assert (s != 0xFFFFFFFFFFFFFFFF).all()
        off.append(abs((s[0] == s[1]).mean() - share))
    assert max(off) < 5 * (0.25 / BINS) ** 0.5


def substring_oracle(rows, window):
    words = [WORD.findall(t or "") for _, t, _ in rows]
    least = {}
    for (i, _, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            order = float("inf") if i is None else i
            least[key] = min(least.get(key, order), order)
    out = []
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < (float("inf") if i is None else i):
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "hot"), [(50, 4096), (20, 2), (9, 4096)])
def test_substring_dedup(corpus, window, hot):
    from cellmosaic.llm.substring_dedup import substring_dedup

    rows, docs = corpus
    assert rows_of(substring_dedup(docs, window, hot=hot), "doc_id", "n_words", "n_removed", "text") == substring_oracle(rows, window)


def test_fm_index_streams_other_texts():
    """Matching statistics of texts that the index doesn't hold, against all pairs of windows."""
    from cellmosaic.llm.fm_index import NONE, FMIndex

    g = np.random.default_rng(0)
    for _ in range(40):
        depth, letters = int(g.integers(1, 13)), int(g.integers(1, 6))
        held, asked = ([g.integers(0, letters, g.integers(0, 60)).astype(np.uint64) for _ in range(n)] for n in (int(g.integers(0, 6)), 8))
        asked = [np.concatenate([t, held[g.integers(len(held))], t[:5]]) if held and g.random() < 0.6 else t for t in asked]
        asked[0] = asked[0] + np.uint64(1)  # a word that no text has
        flat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.uint64), np.append(0, np.cumsum([len(t) for t in x])).astype(np.int64))
        values = g.integers(0, 99, len(held))
        least = {}
        for t, v in zip(held, values, strict=True):
            for i in range(len(t) - depth + 1):
                key = tuple(t[i : i + depth])
                least[key] = min(int(v), least.get(key, NONE))
        index = FMIndex(*flat(held), values, depth)
        assert index.matches(*flat(asked)).tolist() == [least.get(tuple(t[i : i + depth]), NONE) for t in asked for i in range(len(t) - depth + 1)]
    base = g.integers(0, 20_000, 40_000).astype(np.uint64)
    index = FMIndex(np.tile(base, 5), np.arange(0, 200_001, 100), np.arange(2000), 50)
    assert index.nbytes < 4 * 200_000  # bytes: repeated passages are runs


def test_substring_dedup_of_one_repeated_word_and_of_hot_names(make, monkeypatch):
    """Long runs of one word are few distinct segments; names too many to go out with the tasks come by a join, with the same rows."""
    from cellmosaic.llm import substring_dedup as op

    rows = [(1, "a " * 60_000, "s"), (2, "a " * 70_000 + "b", "s"), (2, "a " * 70_000 + "b", "s"), (3, "c " + "a " * 49, "s"), (4, "a " * 49 + "c", "s"), (5, "a " * 50 + "c", "s")]
    own = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in op.substring_dedup(make(rows)).collect()}
    assert own == {1: (60_000, 0), 2: (70_001, 70_000), 3: (50, 0), 4: (50, 0), 5: (51, 51)}
    base = prose(90).split()
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k:]) + " " + prose(12), "s") for k in range(80)]
    for most in (500_000, 0):
        monkeypatch.setattr(op, "BROADCAST_NAMES", most)
        assert rows_of(op.substring_dedup(make(rows + rows[:9]), 20, hot=3), "doc_id", "n_words", "n_removed", "text") == substring_oracle(rows + rows[:9], 20)


def test_contamination(make, spark):
    from cellmosaic.llm.decontaminate import contamination

    items = [(k, prose(rng.randint(14, 50))) for k in range(40)] + [(90, "too short"), (91, None), (None, prose(20))]
    rows = [(k, prose(150), "a") for k in range(40)]
    for k in range(40):
        words, most = items[k][1].split(), len(items[k][1].split()) // 5
        for _ in range(rng.choice((0, most, most + 6))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
        rows.append((100 + k, prose(40) + " " + " ".join(words).upper() + "! " + prose(40), "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: sorted({m["item_id"] for m in r["matches"] if m["item_id"] is not None}) for r in contamination(make(rows), bench).collect()}

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for i, t, _ in rows:
        words = re.findall(r"[a-z0-9]+", t.lower())
        assert got[i] == sorted(k for k, x in items[:40] if least(x.split(), words) <= len(x.split()) // 5)


def test_mix(corpus):
    from cellmosaic.llm.mixing import mix_sources, source_targets

    rows, docs = corpus
    plan = mix_sources(docs)
    out = plan.taken().collect()
    assert Counter(r["id"] for r in out) == Counter(i for i, _, _ in rows)
    size = {i: len(WORD.findall(t)) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    names = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i in size if source[i] == s) for s in names]
    target = source_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    assert sum(target) == pytest.approx(sum(sizes))
    for k, s in enumerate(names):
        own = [r for r in out if source[r["id"]] == s]
        assert all(r["size"] == size[r["id"]] and r["source_size"] == sizes[k] and r["target"] == pytest.approx(target[k]) and r["taken"] <= 3 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target[k]) <= 1
    assert rows_of(mix_sources(docs.repartition(5)).taken(), "id", "taken") == sorted(((r["id"], r["taken"]) for r in out), key=repr)
    # any early part of the schedule is near the shares, too
    slots = plan.slots.orderBy("slot").select("src", (F.col("hi") - F.col("lo")).alias("n")).collect()
    half = slots[: len(slots) // 2]
    for k in range(len(names)):
        assert sum(r["n"] for r in half if r["src"] == k) == pytest.approx(target[k] / 2, rel=0.05, abs=30)


def test_targets_are_capped_and_reshared():
    from cellmosaic.llm.mixing import source_targets

    assert source_targets([10, 10, 980], [5, 2, 1], 3) == pytest.approx([30, 30, 940])
    assert source_targets([0, 8], [5, 2], 3) == [0, 8]
    assert source_targets([], [], 3) == []


def test_token_files(corpus):
    from tokenizers import Tokenizer

    from cellmosaic.llm.token_output import read_tokens, write_tokens

    rows, docs = corpus
    path = public_tokenizers.path("word_bpe_49k.json")
    library, at, want = Tokenizer.from_file(path), 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    for size in (8 << 20, 500):
        got = read_tokens(write_tokens(docs, path, file_tokens=size), with_ids=True)
        assert rows_of(got, "id", "start", "n_tokens", "ids_crc32", "ids") == sorted(want, key=repr)


def test_words_encode_as_texts():
    from tokenizers import Tokenizer

    from cellmosaic.llm.token_output import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    words = ["don't", "Straße", "x" * 300, "12ab34", "!?", "(hello)", "é", " ", "<|endoftext|>", "ÀÉ,", "中文", "\x01", "--a--", "I'LL", "ﬁ"]
    assert [x.tolist() for x in WordEncoder(path).words(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]


@pytest.mark.parametrize("n", [1, 7, 4096])
def test_blocks_round_trip(n):
    from cellmosaic.llm.token_output import pack_block, unpack_block

    g = np.random.default_rng(n)
    for top in (1, 2, 300, 70_000, (1 << 32) - 1):
        ids = np.where(g.random(n) < 0.97, g.integers(0, max(1, top // 50 + 1), n), g.integers(0, top, n, endpoint=True)).astype(np.uint32)
        for percentile in (50.0, 98.0, 100.0):
            assert (unpack_block(pack_block(ids, percentile), n) == ids).all()


def test_token_counts(corpus):
    from cellmosaic.llm.token_counts import LongestMatch, load_vocabulary, token_counts

    def greedy(word, first, later):
        k = n = 0
        while k < len(word):
            own = later if k else first
            end = next((j for j in range(len(word), k, -1) if word[k:j] in own), None)
            if end is None:
                return -1
            k, n = end, n + 1
        return n

    for _ in range(300):
        pieces = lambda: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        first, later = pieces(), pieces()
        automaton = LongestMatch(first, later)
        for _ in range(10):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            assert automaton.count(word) == greedy(word, first, later), (first, later, word)
    rows, docs = corpus
    path = public_tokenizers.path("piece_bpe_32k.model")
    first, later = map(set, load_vocabulary(path))
    want = []
    for i, t, _ in rows:
        n = [greedy(w, first, later) for w in WORD.findall(t)]
        want.append((i, len(n), sum(map(abs, n)), sum(x < 0 for x in n)))
    assert rows_of(token_counts(docs, path), "doc_id", "n_words", "n_tokens", "n_unknown") == sorted(want, key=repr)


def test_nearest(spark):
    from cellmosaic.llm.ann import nearest

    g = np.random.default_rng(2)
    x = g.standard_normal((2000, 24))
    x[500:800] = x[500]
    x[900] = 2 * x[500]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, None]), (None, [1.0] * 24), (5010, [1.0, 2.0]), (5020, [1.0, 2.5])]
    got = defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    norm = np.linalg.norm(x, axis=1)
    hit = 0
    for q in range(0, 2000, 10):
        score = x @ x[q] / (norm * norm[q])
        score[q] = -9
        best = np.lexsort((np.arange(2000), -score.round(12)))[:5]
        hit += len(set(best) & {i for i, _ in got[q]})
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in got[q]) and len(got[q]) == 5
    assert hit >= 0.9 * 1000
    assert [i for i, _ in got[510]][:3] == [500, 501, 502]
    assert [i for i, _ in got[5010]] == [5020]


def test_warc(spark):
    from cellmosaic.llm.warc import read_record, read_warc, url_key, write_index, write_warc

    big, other = "ß" * 700, "y" * 1500
    rows = [(1, "http://a.example/x", big), (2, "http://B.example:80/x?q=1", big), (3, None, big), (4, "http://a.example/x", other), (5, "not a url", "small"), (6, "http://c.example/", "small"), (7, "http://c.example/", None), (7, "http://c.example/", None), (None, "http://d.example/", other), (4, "http://a.example/x", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = write_warc(pages, 1000)
    index = write_index(captures, block_lines=2)
    most = {big: 3, other: 4}
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = most[h] if h in most and (i is None or i < most[h]) else None
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to is not None else "response", to))
    assert rows_of(read_warc(index), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert url_key("HTTP://User@Www.Example.org:8080/a?b") == "org,example,www:8080)/a?b"
    found = index.lookup("http://a.example/x")
    assert sorted(c["page_id"] for c in found) == [1, 4, 4]
    assert {read_record(c)["payload_digest"] for c in found} == {hashlib.sha1(t.encode()).hexdigest() for t in (big, other)}
    assert index.lookup("http://nowhere.example/") == []


def test_toxicity(make, spark):
    from cellmosaic.llm.toxicity import fit_toxicity, held_out, score_toxicity

    rows, labels = [], []
    for k in range(900):
        bad, words = k % 3 == 0, prose(30).split()
        if bad:
            words[3:5] = [rng.choice(("scumbag", "scumlike", "idiotic", "idiots")), rng.choice(("idiot", "scum", "scummy"))]
        rows.append((k, " ".join(words), "a"))
        labels.append((k, int(bad)))
    docs, given = make(rows), spark.createDataFrame([*labels, (9999, 1), (5, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, given)
    out = score_toxicity(docs, model).select("row.doc_id", "score", held_out(F.col("row.doc_id")).alias("held")).collect()
    own = [(r["score"] >= 0.5, r["doc_id"] % 3 == 0) for r in out if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert len(own) > 100 and sum(a == b for a, b in own) >= 0.97 * len(own)
    unseen = score_toxicity(make([(1, prose(20) + " scumball idiotz", "a"), (2, prose(22), "a")]), model).orderBy("row.doc_id").collect()
    assert unseen[0]["score"] > unseen[1]["score"]
    none = fit_toxicity(docs, given.filter("toxic = 0"))
    assert all(r["score"] < 1e-6 for r in score_toxicity(docs, none).collect())


def test_odd_and_empty_tables(spark, odd, empty):
    """Defined results for nulls, empty and long texts, ties and repeated rows; empty tables give empty results."""
    from cellmosaic.llm.ann import nearest
    from cellmosaic.llm.decontaminate import contamination
    from cellmosaic.llm.line_dedup import line_dedup
    from cellmosaic.llm.mixing import mix_sources
    from cellmosaic.llm.near_dedup import near_duplicates
    from cellmosaic.llm.substring_dedup import substring_dedup
    from cellmosaic.llm.token_counts import token_counts
    from cellmosaic.llm.token_output import read_tokens, write_tokens
    from cellmosaic.llm.toxicity import fit_toxicity, score_toxicity
    from cellmosaic.llm.warc import read_warc, write_index, write_warc

    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert rows_of(line_dedup(odd, 2, "none"), "doc_id", "n_lines", "n_dropped", "text") == lines_oracle(rows, 2, "none")
    assert rows_of(near_duplicates(odd, 4), "doc_id", "n_shingles", "component_id", "kept") == near_oracle(rows, 4, 80)
    assert rows_of(substring_dedup(odd, 5), "doc_id", "n_words", "n_removed", "text") == substring_oracle(rows, 5)
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9"), (None, None)], "item_id long, text string")
    assert {r["id"] for r in contamination(odd, bench).filter(F.size("matches") > 0).collect()} == {4, 5}
    assert mix_sources(odd).taken().agg(F.sum("taken")).first()[0] == pytest.approx(sum(len(WORD.findall(t or "")) for _, t, _ in rows), abs=4)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = read_tokens(write_tokens(odd, path)).orderBy("start").collect()
    assert len(tokens) == len(rows) and tokens[0]["id"] is None and min(r["n_tokens"] for r in tokens) == 1
    counts = token_counts(odd, public_tokenizers.path("piece_bpe_32k.model"))
    assert rows_of(counts, "doc_id", "n_words") == sorted(((i, len(WORD.findall(t or ""))) for i, t, _ in rows), key=repr)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    scores = score_toxicity(odd, fit_toxicity(odd, labels)).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)

    assert line_dedup(empty).count() == near_duplicates(empty).count() == substring_dedup(empty).count() == contamination(empty, bench).count() == 0
    assert contamination(odd, bench.limit(0)).filter(F.size("matches") > 0).count() == mix_sources(empty).taken().count() == 0
    assert read_tokens(write_tokens(empty, path)).count() == token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert score_toxicity(empty, fit_toxicity(empty, labels.limit(0))).count() == 0
    assert nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert read_warc(write_index(write_warc(spark.createDataFrame([], "page_id long, url string, html string")))).count() == 0
