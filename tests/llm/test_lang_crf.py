import random
import zlib
from itertools import product

import numpy as np
import pytest

from ridelens.llm import lang_crf as op

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, score STRING, turn INT, found INT"


@pytest.mark.parametrize("block", [1, 3, 32])
def test_forward_backward_against_all_paths(monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(1)
    sizes, n = np.array([1, 5, 2, 7]), 3
    scores, move, start = rng.normal(size=(sizes.sum(), n)), rng.normal(size=(n, n)), rng.normal(size=n)
    got = op.marginals(scores, sizes, move, start)
    at = 0
    for size in sizes:
        part, want = scores[at:at + size], np.zeros((size, n))
        for path in product(range(n), repeat=int(size)):
            score = start[path[0]] + sum(part[t, k] for t, k in enumerate(path)) \
                + sum(move[a, b] for a, b in zip(path, path[1:]))
            want[range(size), path] += np.exp(score)
        assert got[at:at + size] == pytest.approx(want / want.sum(1, keepdims=True))
        at += size


def test_features_are_the_named_ones():
    """Words share a feature number exactly where they share the named feature."""
    words = ["ab", "abc", "xab", "b", "straße", "a" * 40]
    owner, number = op.features(words, {"abc"})

    def names(word):
        if len(word) > op.MAX_WORD:
            word = word[:op.MAX_WORD // 2] + word[-op.MAX_WORD // 2:]
        marked = f"^{word}$"
        for k in range(1, op.MAX_GRAM + 1):
            for i in range(len(marked) - k + 1):
                yield "gram", marked[i:i + k]
        for k in range(1, min(op.MAX_AFFIX, len(word)) + 1):
            yield "prefix", word[:k]
            yield "suffix", word[-k:]
        if word == "abc":
            yield "word", word
    numbers = {}
    for i, word in enumerate(words):
        wanted = list(names(word))
        found = number[owner == i]
        assert len(found) == len(wanted)
        numbers[i] = (set(wanted), set(found.tolist()))
    for i, j in product(numbers, repeat=2):
        shared = numbers[i][0] & numbers[j][0]
        assert len(numbers[i][1] & numbers[j][1]) == len(shared)


SYLLABLES = {"aa": ["ka", "to", "mi", "ren"], "bb": ["sch", "ung", "ber", "eit"], "cc": ["ção", "os", "mente", "é"]}


def words(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(n))


def make_rows(rng, n=400):
    rows = [(1_000 + i, t, x) for i, (t, x) in enumerate(
        [(None, "aa"), ("", "bb"), ("12 ... 34", "cc"), ("kato mi", None)])]
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, words(rng, lang, rng.randrange(3, 60)), None if i % 11 == 0 else lang))
    return rows


def test_held_out_accuracy(spark):
    rows = make_rows(random.Random(2))
    rows.append(rows[20])
    docs = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in op.language_report(docs).collect()}
    right = []
    for i, text, lang in rows:
        held = zlib.crc32(str(i).encode()) % 3 == 1
        assert got[i].held_out == held and 0 <= got[i].score <= 1
        if i >= 1_000 and i < 1_003:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        elif held and lang:
            right.append(got[i].lang_pred == lang)
    assert len(right) > 80 and sum(right) > .97 * len(right)


def test_code_switched_words():
    rng = random.Random(3)
    rows = [(words(rng, x, 50), x) for x in SYLLABLES for _ in range(40)]
    model = op.fit([t for t, _ in rows], [x for _, x in rows])
    assert (np.diag(model.transitions) > model.transitions.mean(1)).all()
    want, text = [], []
    for _ in range(10):
        lang = rng.choice(list(SYLLABLES))
        part = words(rng, lang, 15)
        text.append(part)
        want += [lang] * len(op.words_of(part))
    probabilities = model.label([op.words_of(" ".join(text))])[0]
    got = [model.languages[k] for k in probabilities.argmax(1)]
    assert sum(a == b for a, b in zip(got, want)) > .93 * len(want)
    assert model.identify([None, "", "123", words(rng, "bb", 4)])[0] == ["und"] * 3 + ["bb"]


def test_pieces_and_batches_of_long_texts(monkeypatch):
    rng = random.Random(4)
    rows = [(words(rng, x, 30), x) for x in SYLLABLES for _ in range(20)]
    model = op.fit([t for t, _ in rows], [x for _, x in rows])
    texts = [words(rng, x, 3_000) for x in SYLLABLES] + ["", "kato"]
    assert "".join(op.pieces(texts[0])) == texts[0]
    whole = model.identify(texts)
    monkeypatch.setattr(op, "PIECE_CHARS", 500)
    monkeypatch.setattr(op, "BATCH_WORDS", 700)
    langs, scores = model.identify(texts)
    assert langs == whole[0] == ["aa", "bb", "cc", "und", "aa"]
    assert scores == pytest.approx(whole[1], abs=.01)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "kato", None), (None, None, "aa")], "doc_id BIGINT, text STRING, lang STRING")
    assert {(r.lang_pred, r.score) for r in op.language_report(docs).collect()} == {("und", 0.0)}
    assert op.language_report(docs.limit(0)).collect() == []


def test_no_label_is_left_out_of_the_sample(spark, monkeypatch):
    """More than 200 labels, and a crowd of rows without an id."""
    rows = [(i, f"text {i}", f"l{i % 230:03d}") for i in range(460)]
    rows += [(None, f"crowd {i}", "crowd") for i in range(3000)] + [(None, "alone", "small")]
    docs = spark.createDataFrame([(d, t, g, "s", 1, 2) for d, t, g in rows], SCHEMA)
    taken = {}
    monkeypatch.setattr(op, "fit", lambda texts, langs: taken.update(zip(texts, langs)))
    op.train(docs, per_language=2)
    assert set(taken.values()) == {g for _, _, g in rows} and len(taken) == 230 * 2 + 2 + 1


def test_number_signs_are_no_letters():
    assert op.words_of("½ ² ① 12 _ ٣") == []
    assert op.words_of("a½b x²Y ①") == ["a", "b", "x", "y"]
    model = op.fit([words(random.Random(1), "aa", 30), words(random.Random(2), "bb", 30)] * 4, ["aa", "bb"] * 4)
    assert model.identify(["½", "²①", "٣ 4"]) == (["und"] * 3, [0.0] * 3) or \
        [list(x) for x in model.identify(["½", "²①", "٣ 4"])] == [["und"] * 3, [0.0] * 3]
