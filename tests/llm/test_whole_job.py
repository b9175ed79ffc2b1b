"""Input that operators once left out."""

import random

import public_tokenizers
import pytest

rng = random.Random(5)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts_hold_the_mark_and_bytes(make):
    """Against greedy matching of the mark and the word over the model's own piece list."""
    import sentencepiece

    from cellmosaic.llm.token_counts import LongestMatch, token_counts

    def greedy(word, pieces):
        k, n = 0, 0
        while k < len(word):
            end = next((j for j in range(len(word), k, -1) if word[k:j] in pieces), None)
            k, n = (end, n + 1) if end else (k + 1, n + len(word[k].encode()))
        return n

    for _ in range(300):
        pieces = {rng.choice(("", "▁")) + "".join(rng.choice("abñ") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))} | set(rng.choice(((), ("▁",))))
        automaton = LongestMatch([p[1:] for p in pieces if p[0] == "▁"], pieces, True)
        for _ in range(10):
            word = "".join(rng.choice("abñ▁") for _ in range(rng.randint(1, 9)))
            assert automaton.count(word) == greedy("▁" + word, pieces), (pieces, word)
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p for k, p in enumerate(map(model.id_to_piece, range(model.get_piece_size()))) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}
    rows = [(k, t, "a") for k, t in enumerate(("ñado ça être ß", "中文 x\U00013000y ▁ a▁▁b", "plain words", "\U00013000", "ñ ñ ñado"))]
    want = [(k, len(t.split()), sum(greedy("▁" + w, pieces) for w in t.split()), 0) for k, t, _ in rows]
    assert want[3][2] == 5 and want[4][2] == 7  # the mark and four bytes; mark ñ, mark ñ, mark ñ ado
    assert rows_of(token_counts(make(rows), path), "doc_id", "n_words", "n_tokens", "n_unknown") == want


VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("b", "d", "st", "rr", "n", "x", "gh")]


def prose(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.mark.parametrize("kind", ["drop", "add", "swap"])
def test_contamination_finds_items_of_all_lengths(make, spark, kind):
    """Each item at its full edit budget, scattered or at random, with edits of one kind."""
    from cellmosaic.llm.decontaminate import contamination

    items, rows = [], []
    for k, n in enumerate((15, 30, 59, 100, 150, 250, 400) * 6):
        own = prose(n)
        text = list(own)
        for at in sorted(rng.sample(range(n), n // 5), reverse=True):
            text[at : at + (kind != "add")] = [] if kind == "drop" else [f"e{rng.randrange(9999)}"]
        items.append((k, " ".join(own)))
        rows.append((k, " ".join(prose(60) + text + prose(60)), "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["id"]: [m["item_id"] for m in r["matches"]] for r in contamination(make(rows), bench).collect()}
    assert all(k in got[k] for k in range(len(rows)))


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_contamination_of_short_items(make, spark, monkeypatch, percent):
    """Items of 0 to 7 words against brute force, also with few pairs at a time."""
    from cellmosaic.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PAIRS", 50)

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    items = [[rng.choice("abcde") for _ in range(n)] for n in range(8) for _ in range(5)] + [["q", "q"]]
    texts = [[rng.choice("abcdefgh") for _ in range(rng.randrange(30))] for _ in range(60)]
    own = decontaminate.Items([[k] for k in range(len(items))], decontaminate._bare_words([" ".join(x) for x in items]), percent)
    words = decontaminate._bare_words([" ".join(t) for t in texts])
    first = decontaminate.np.cumsum([0, *map(len, words)])
    found = own.matches(decontaminate.np.concatenate(words), first)
    for r, t in enumerate(texts):
        want = [k for k, x in enumerate(items) if x and least(x, t) <= len(x) * (100 - percent) // 100]
        assert sorted({i for m in found.get(r, ()) for i in own.ids[m[0]]}) == want
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = decontaminate.contamination(make([(1, "Q! q", "a"), (2, "q a", "a"), (3, None, "a")]), bench, 100).collect()
    assert {r["id"]: 40 in [m["item_id"] for m in r["matches"]] for r in got} == {1: True, 2: False, 3: False}
