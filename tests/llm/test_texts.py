"""Tokens, leaks and abuse on small texts."""

import base64
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantgauge.llm.abuse import LabelModel, Tagger, Voters, abuse_scores, bits_of, fit_label_model, segments, train_linear
from plantgauge.llm.leaks import PassageIndex, banded, bands_of, find_leaks, holds_row, in_runs, leaked_items, longest_row, occurrences, pieces
from plantgauge.llm.queries import tokenizer_path
from plantgauge.llm.textnorm import fold, letters
from plantgauge.llm.tokens import PairIndexEncoder, encode_corpus

PATH = tokenizer_path()
ENCODER = PairIndexEncoder(PATH)


def public():
    import public_tokenizers
    import tiktoken

    lines = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PUBLIC = public()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_equal_the_public_tokenizer(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ENCODER.encode([text]) == [PUBLIC.encode_ordinary(text)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab abé1. '\n", max_size=60), max_size=5))
def test_ids_of_batches_of_few_letters(texts):
    assert PairIndexEncoder.encode(ENCODER, texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_ids_of_a_corpus(spark):
    texts = [None, "", " ", "a" * 60_000, "<|endoftext|> we'll see", "x" * 10 + "\r\n\t 🙂 汉字", "same", "same"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, "no id", "n")], "doc_id long, text string, ids string")
    for chars in (10, 4_000_000):
        got = {r.doc_id: r.ids for r in encode_corpus(df, PATH, batch_chars=chars).collect()}
        assert got == {**{i: PUBLIC.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}, None: PUBLIC.encode_ordinary("no id")}
    assert encode_corpus(df.where("false"), PATH).count() == 0


def test_memory_of_pretokens_is_bounded():
    e = PairIndexEncoder(PATH, remember=3)
    assert e.encode(["one two", "three four five", "one two"]) == [PUBLIC.encode_ordinary(t) for t in ("one two", "three four five", "one two")]


WORDS = "under the rule of the old harbour every fourth boat carried a lantern painted green so that the pilot could tell at a glance whether its owner had paid the yearly toll to the keeper of the northern light".split()
PASSAGE = " ".join(WORDS)
FILLER = "Nothing of note happened in the morning and the crew had a long rest before dinner was served on deck. "


def leaks(texts, **kw):
    index = PassageIndex([(5, PASSAGE)], 8, 20)
    return {d: n for d, _, n in find_leaks(index, [letters(t) for t in texts], **kw)}


def test_leaks_however_disguised():
    typo = WORDS.copy()
    typo[5], typo[12], typo[20] = "harbuor", "grene", "gllance"
    cases = [
        FILLER + PASSAGE,
        FILLER + " ".join(WORDS[3:25]).upper() + ". " + FILLER,
        FILLER + " ".join(typo) + FILLER,
        "<p>" + "</p>\n> <b>".join(", ".join(WORDS[i : i + 3]) for i in range(0, 30, 3)) + "</b>",
        " ".join([*WORDS[:15], "(as the reader of this log will surely remember)", *WORDS[15:]]),
        PASSAGE.replace("o", "о").replace(" ", "  "),
    ]
    found = leaks(cases)
    assert set(found) == set(range(len(cases))) and min(found.values()) >= 20


def test_no_leaks():
    cases = [FILLER, " ".join(WORDS[:14]) + " " + FILLER, " ".join(WORDS[::-1]), "", " ".join(w if i % 3 else "other" for i, w in enumerate(WORDS)), FILLER.join(" ".join(WORDS[i : i + 9]) for i in range(0, 36, 9))]
    assert leaks(cases) == {}
    for few in (["under the rule of"], [" ".join(WORDS[:9])], ["", ""], []):
        assert leaks(few) == {}


def test_leaks_of_tables(spark):
    docs = spark.createDataFrame([(1, FILLER * 300 + PASSAGE + FILLER, "x"), (2, None, "x"), (3, "", "x"), (None, PASSAGE, "x"), (1, FILLER + PASSAGE, "x"), (4, FILLER, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, PASSAGE, None), (7, PASSAGE, None), (8, "too short", "q"), (9, None, "q"), (None, PASSAGE, "q")], "item_id long, passage string, doc_id string")
    for chars in (8_000_000, 60):
        assert [(r.item_id, r.doc_id, r.n_words) for r in leaked_items(docs, items, block_chars=chars).collect()] == [(7, 1, len(WORDS))]
    assert leaked_items(docs, items.where("false")).count() == 0 and leaked_items(docs.where("false"), items).count() == 0


def brute_edits(p, t, longest):
    """Least edits between p and any part of t; a row of put in characters costs `longest` at most."""
    row = np.zeros(len(t) + 1, int)
    for i, c in enumerate(p, 1):
        new = np.array([min(row[j] + 1, row[j - 1] + (t[j - 1] != c) if j else i) for j in range(len(t) + 1)])
        row = np.array([min(new[k] + min(j - k, longest) for k in range(j + 1)) for j in range(len(t) + 1)])
    return row.min()


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", min_size=1, max_size=14), st.sampled_from([2, 3, 100]))
def test_banded_alignment_is_of_least_cost(p, t, longest):
    # a band as wide as all diagonals: what isn't matched on the path, with the jumps between, is the edit distance
    pad, width = len(p), len(p) + len(t) + 1
    one = np.array([[ord(c) for c in p]], np.uint32)
    text = np.zeros((1, len(p) + width - 1), np.uint32)
    text[0, pad : pad + len(t)] = [ord(c) for c in t]
    matched, shift = banded(one, text, np.array([0]), width, longest)
    matched, shift = matched[0], shift[0]
    met = np.flatnonzero(shift >= 0)
    assert all(text[0, i + shift[i]] == one[0, i] for i in np.flatnonzero(matched))
    jumps = [(b + shift[b]) - (a + shift[a]) - 1 for a, b in zip(met, met[1:], strict=False)]
    assert all(j >= 0 for j in jumps)
    assert (~matched).sum() + sum(min(j, longest) for j in jumps) == brute_edits(p, t, longest)


def brute_row(good, odd, after=None):
    n, most = len(good), 0
    for i in range(n):
        for j in range(i + 1, n + 1):
            for c in range(i, j + 1) if after is not None else (j,):
                row = np.concatenate((good[i:c], (good if after is None else after)[c:j]))
                if good[i] and (good if after is None else after)[j - 1] and (~row).sum() * 10_000 <= round(odd * 10_000) * len(row):
                    most = max(most, j - i)
    return most


@pytest.mark.parametrize("seed", range(30))
def test_rows_of_words(seed):
    rng = np.random.default_rng(seed)
    good, after = rng.random(24) < 0.7, rng.random(24) < 0.6
    assert longest_row(good, 0.15) == brute_row(good, 0.15)
    assert max(longest_row(good, 0.15, after), longest_row(good, 0.15), longest_row(after, 0.15)) == max(brute_row(good, 0.15, after), longest_row(good, 0.15), longest_row(after, 0.15))
    rows = [rng.random(n) < 0.85 for n in rng.integers(0, 60, 50)]
    told = holds_row(np.concatenate(rows), np.array([len(r) for r in rows]), 20, 0.15)
    assert all(t for t, r in zip(told, rows, strict=True) if brute_row(r, 0.15) >= 20)


def test_pieces_and_bands():
    assert pieces("abcdefgh", 4, 2) == ["abcd", "cdef", "efgh"] and pieces("ab", 4, 2) == ["ab"] and pieces("", 4, 2) == [""]
    assert in_runs(np.array([[True] * 4 + [False] + [True] * 3]), np.array([[5] * 6 + [6] * 2]), 3).tolist() == [[True] * 4 + [False] * 4]
    rng = np.random.default_rng(0)
    shift = rng.integers(-200, 200, 60)
    hit, cell = bands_of(shift, np.zeros(60, int), 16)
    bands = [set(hit[cell == c]) for c in set(cell)]
    for x in range(60):  # any hits that span less than a cell lie in one band
        near = set(np.flatnonzero((shift >= shift[x]) & (shift <= shift[x] + 16)))
        assert any(near <= b for b in bands)


def test_leak_beside_many_copies_of_a_phrase():
    # 500 copies of 7 words of the passage, and 21 words with three odd ones, so that all stretches are shorter than the copies
    phrase = " ".join(WORDS[30:37])
    odd = WORDS[:21]
    odd[5], odd[10], odd[15] = "xxxxxx", "yyyyy", "zz"
    text = (phrase + " 0123 ") * 500 + FILLER * 4 + " ".join(odd) + ". " + FILLER
    assert max(len("".join(x)) for x in (odd[:5], odd[6:10], odd[11:15], odd[16:21])) < len(letters(phrase))
    assert leaks([text]) == {0: 21}


def test_leak_beside_a_share_of_more_letters():
    # 19 words of more letters, no case by themselves, then 20 shorter ones far away in the same text
    items = ["considerable resistance throughout neighbouring installations " * 3 + "considerable resistance throughout neighbouring", " ".join(WORDS)]
    long_ = [w + "abcdefghijklmnopqrst"[i] for i, w in enumerate(items[0].split())]
    passage = " ".join(long_ + ["zzz"] * 6 + WORDS)
    index = PassageIndex([(5, passage)], 8, 20)
    text = " ".join(long_) + ". " + FILLER * 10 + " ".join(WORDS[:20]) + ". " + FILLER
    assert len(long_) == 19 and len("".join(long_)) > len("".join(WORDS[:20]))
    assert list(find_leaks(index, [letters(text)])) == [(0, 0, 20)]


def test_leak_of_twenty_words_with_three_long_ones_changed_and_an_insertion():
    rng = np.random.default_rng(4)
    odd = {3, 7, 12}
    row = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 15 if i in odd else 5)) for i in range(20)]
    index = PassageIndex([(5, " ".join(row))], 8, 20)
    changed = ["0" * 15 if i in odd else w for i, w in enumerate(row)]
    text = FILLER + " ".join(changed[:16]) + " (as the reader of this log will surely still remember) " + " ".join(changed[16:]) + ". " + FILLER
    assert list(find_leaks(index, [letters(text)])) == [(0, 0, 20)]


@pytest.mark.parametrize("captions", [0, 3, 6, 10, 25])
def test_leak_beside_repeated_captions(captions):
    # a caption stands again and again in both texts, beside 30 words word for word
    caption = "figure taken from the yearly survey of the northern pilots "
    passage = caption * captions + " ".join(WORDS[:30])
    index = PassageIndex([(5, passage)], 8, 20)
    text = FILLER + " ".join(WORDS[:30]) + ". " + (caption + "0123 ") * captions + FILLER
    found = dict((i, n) for _, i, n in find_leaks(index, [letters(text)]))
    assert found.get(0, 0) >= 30


def test_repeats_of_a_phrase_in_both():
    phrase = " ".join(WORDS[:14]) + " "
    for n in (19, 20, 40):
        passage = (phrase + "then ") * n + " ".join(WORDS[3:33][::-1])
        text = (phrase + "0123 ") * n + " ".join(WORDS[3:33][::-1])
        assert [i for _, i, _ in find_leaks(PassageIndex([(5, passage)], 8, 20), [letters(text)])] == [0]


def test_hot_qgrams_are_taken_in_parts():
    # 400 items share a sentence; held at once are a few thousand hits, and the leaks are the same
    rng = np.random.default_rng(1)
    own = [" ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(24)) for _ in range(400)]
    index = PassageIndex([(i, " ".join(WORDS[:14]) + " " + o) for i, o in enumerate(own)], 8, 20)
    texts = [letters((" ".join(WORDS[:14]) + ". ") * 30 + own[i]) for i in (3, 77)] + [letters(FILLER)]
    want = [(0, 3), (1, 77)]
    largest, real = [], index.hits
    index.hits = lambda *a: (largest.append(len((x := real(*a))[0])), x)[1]
    for bound in (2_000_000, 20_000, 500):
        largest.clear()
        assert sorted((d, i) for d, i, _ in find_leaks(index, texts, hits=bound)) == want
        assert max(largest) <= max(4 * bound, 5_000)


def test_long_texts_are_searched_in_pieces(spark):
    docs = spark.createDataFrame([(1, FILLER * 60 + PASSAGE + FILLER * 60)], "doc_id long, text string")
    items = spark.createDataFrame([(7, PASSAGE)], "item_id long, passage string")
    assert [r.n_words for r in leaked_items(docs, items, piece_chars=1).collect()] == [len(WORDS)]


def test_counts_of_any_bound():
    values = np.array([3, 3, 9])
    assert occurrences(values).tolist() == [2, 2, 1] and occurrences(values * 10**9).tolist() == [2, 2, 1]
    assert occurrences(values[:0]).tolist() == []


def test_folding():
    assert fold("<b>Füß</b> &amp; ＡＢＣ​") == " fuss  & abc" or fold("<b>Füß</b> &amp; ＡＢＣ​").split() == ["fuss", "&", "abc"]
    assert letters("Sensor_05, l/min\nÉté") == "sensor05lminete"


@pytest.mark.parametrize("text", ["you are an idiot", "you are an 1d1ot", "you are an i.d.i.o.t", "you are an idiiiiot", "you are an id*ot", "you are an idoit", "YOU ARE AN I D I O T", "you are an іdіоt", "you are an idi​ot"])
def test_disguised_words_are_tagged(text):
    (s,) = segments(text)
    assert "INS" in Tagger().tagged(s).split()


@pytest.mark.parametrize("text", ["the pitch linkage tripped", "carbon seal of the tanker", "lose no time, check the valve", "horn test, 12 bits per sample", "score sank to 12.5"])
def test_ordinary_words_are_not(text):
    assert not {"INS", "SXB", "SXA", "DEH"} & set(Tagger().tagged(segments(text)[0]).split())


def test_label_model_trusts_voters_that_agree():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.1
    good = [np.where(y, rng.random(20000) < 0.8, rng.random(20000) < 0.01) for _ in range(3)]
    bad = rng.random(20000) < 0.1
    bits = sum(v.astype(int) << j for j, v in enumerate([*good, bad]))
    patterns, counts = np.unique(bits, return_counts=True)
    m = fit_label_model(patterns, counts, np.full(4, 0.7), np.zeros(4, bool))
    assert isinstance(m, LabelModel) and m.accuracy[:3].min() > m.accuracy[3]
    assert m.correlation[0, 1] > m.correlation[0, 3]
    p = m.posterior(bits_of(np.array([0, 8, 1, 3, 7]), 4).astype(float))
    assert p[0] == 0 and p[2] < p[3] < p[4]


def test_linear_classifier_separates():
    rng = np.random.default_rng(3)
    rows = [np.array([int(rng.integers(10, 60)), 1 if i % 2 else 2]) for i in range(400)]
    w, b = train_linear(rows, np.arange(400) % 2 * 1.0, np.ones(400), 8)
    z = np.array([w[r].sum() + b for r in rows])
    assert ((z > 0) == (np.arange(400) % 2 == 1)).all() and b < 0


def test_scores_of_a_table(spark):
    plain = [f"Checked the valve of pump {i}, found no rub marks, operator informed. Oil sample taken at 06:{i % 60:02d}." for i in range(150)]
    bad = ["You are a worthless idiot, get off my panel!", "Get rid of every one of the migrants, they are filth.", "send me nudes, you dirty bitch", "one more word and we burn your car", "halt die Klappe, du Arschloch"] * 4
    fine = ["HR notice: insulting, hateful or sexual remarks on the radio are not tolerated and must be reported.", "Bastard file used on the flange face.", "Stupid mistake on my side, sorry.", "Two women and a fitter joined the crew today, welcome."]
    texts = [*plain, *bad, *fine, None, "", "  ", "x" * 100_000]
    df = spark.createDataFrame([(i, t, f"s{i % 2}", "e") for i, t in enumerate(texts)], "doc_id long, text string, source string, score string")
    got = {r.doc_id: r.score for r in abuse_scores(df).collect()}
    assert len(got) == len(texts)
    assert all(got[i] >= 0.5 for i in range(150, 170))
    assert all(s < 0.5 for i, s in got.items() if not 150 <= i < 170)
    assert got[174] == got[175] == 0
    assert abuse_scores(df.where("false")).count() == 0
    assert {r.score for r in abuse_scores(df.where("doc_id < 20")).collect()} == {0.0}


def test_one_voter_name_each():
    v = Voters()
    assert len(v.names) <= 16 and v.pattern("checked the valve") != v.pattern("you are a INS")
