"""Language identification by a linear-chain conditional random field over words.

**Model.** Every word of a text has a language; a word's score per language is
the sum of the weights of its features - its affixes, its letter n-grams and, for
words of the lexicon, the word itself - and neighbouring words are tied by
learned transition weights, so that a code-switched text is labelled in stretches.
Forward-backward gives each word's language probabilities; the text's language
is the one with the largest sum, its score that sum's share.

**Training.** On the driver, on a bounded sample: about ``PER_LANGUAGE`` labelled
texts a language (by a hash of their ids), each at most ``MAX_CHARS`` long. Whole
documents hardly switch language, so the training sequences are spliced from
stretches of texts in random order; the weights climb the conditional likelihood
by adaptive gradient steps.

**Labelling.** Word scores are computed once per distinct word of a batch. The
chain is cut into blocks of ``BLOCK`` words; the blocks' transfer matrices are
multiplied side by side, the blocks are joined in order, and forward and backward
run inside all blocks at once - the exact marginals, without a Python step per
word. Long texts are read in pieces of ``PIECE_CHARS``; the chain restarts there.

Defined results: a NULL text, and a text without letters, gets ``und`` and score
0; so does every text if there is nothing to learn from; NULL labels are not
learned from; repeated rows get equal results; other columns are carried along.
"""

import re
import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.llm.common import id_bucket

FEATURES = 1 << 16
MAX_AFFIX = 4
MAX_GRAM = 3
MAX_WORD = 24                 # a longer word's features come from both its ends
LEXICON_TEXTS = 3             # texts of the sample that must hold a word of the lexicon
PER_LANGUAGE = 150
MAX_CHARS = 20_000
STRETCH = 20                  # mean words of a spliced stretch
SEQUENCE = 64
STEPS = 60
BLOCK = 32
BATCH_WORDS = 100_000
PIECE_CHARS = 1 << 20
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case. (The pattern's runs may hold number signs like those
    for a half or for squares, which are no letters: such runs are parted there.)"""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return ["".join(run) for word in found for letter, run in groupby(word, str.isalpha) if letter]


def _number(hashes: np.ndarray, kind: int) -> np.ndarray:
    """Feature number of a hashed string in its role ``kind``."""
    mixed = (hashes + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(FEATURES)).astype(np.int64)


def features(words: list[str], lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Word and feature number of every feature of the words: n-grams with the word's
    ends marked, prefixes, suffixes, and the word itself if the lexicon has it."""
    short = [w if len(w) <= MAX_WORD else w[:MAX_WORD // 2] + w[-MAX_WORD // 2:] for w in words]
    text = "".join([f"^{w}$" for w in short])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in short], np.int64)
    start = np.cumsum(size) - size
    holder = np.repeat(np.arange(len(words)), size)
    left = (start + size)[holder] - np.arange(len(codes))
    owner, number = [], []
    hashes = np.zeros(len(codes), np.uint64)
    for k in range(1, max(MAX_GRAM, MAX_AFFIX) + 1):
        # the hash of the k letters from each place on (cut off at the end of the batch)
        hashes = hashes[:len(codes) - k + 1] * np.uint64(1_000_003) + codes[k - 1:] + np.uint64(1)
        if k <= MAX_GRAM:
            at = np.flatnonzero(left >= k)
            owner.append(holder[at])
            number.append(_number(hashes[at], k))
        if k <= MAX_AFFIX:
            long = np.flatnonzero(size - 2 >= k)
            for at, kind in ((start[long] + 1, 100 + k), (start[long] + size[long] - 1 - k, 200 + k)):
                owner.append(long)
                number.append(_number(hashes[at], kind))
    known = [i for i, w in enumerate(words) if w in lexicon]
    owner.append(np.array(known, np.int64))
    number.append(_number(np.array([zlib.crc32(words[i].encode("utf-8", "surrogatepass"))
                                    for i in known], np.uint64), 300))
    return np.concatenate(owner), np.concatenate(number)


def word_scores(words: list[str], weights: np.ndarray, lexicon) -> np.ndarray:
    """Score per language of each word."""
    owner, number = features(words, lexicon)
    return np.stack([np.bincount(owner, weights[number, k], len(words))
                     for k in range(weights.shape[1])], 1)


def marginals(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Language probabilities of every word of the chains laid end to end in ``scores``."""
    n_lang, blocks = scores.shape[1], -(-sizes // BLOCK)
    chain = np.repeat(np.arange(len(sizes)), blocks)
    first = np.cumsum(blocks) - blocks
    turn = np.arange(len(chain)) - first[chain]
    begin = (np.cumsum(sizes) - sizes)[chain] + turn * BLOCK
    length = np.minimum(sizes[chain] - turn * BLOCK, BLOCK)
    at = begin[:, None] + np.arange(BLOCK)
    live = np.arange(BLOCK) < length[:, None]
    emit = np.exp(scores - scores.max(1, keepdims=True))
    emit = np.where(live[..., None], emit[np.where(live, at, 0)], 1.0)        # block, place, language
    move = np.exp(transitions - transitions.max())
    head = np.exp(start - start.max())

    def norm(x, axes):
        return x / x.sum(axes, keepdims=True)

    # Transfer matrix of every block; a chain's first word replaces the state, later ones move it.
    transfer = np.broadcast_to(np.eye(n_lang), (len(chain), n_lang, n_lang)).copy()
    opening = turn == 0
    for t in range(BLOCK):
        step = (transfer @ move) * emit[:, t, None, :]
        if t == 0:
            step[opening] = head * emit[opening, 0, None, :]
        on = live[:, t]
        transfer[on] = norm(step[on], (1, 2))
    # State before (and, backwards, after) every block, chain by chain side by side.
    before = np.full((len(chain), n_lang), 1 / n_lang)
    after = np.ones((len(chain), n_lang))
    for k in range(1, int(blocks.max())):
        now = np.flatnonzero(turn == k)
        before[now] = norm(np.einsum("bi,bij->bj", before[now - 1], transfer[now - 1]), 1)
    for k in range(int(blocks.max()) - 2, -1, -1):
        now = np.flatnonzero(turn == k)
        now = now[k + 1 < blocks[chain[now]]]
        after[now] = norm(np.einsum("bij,bj->bi", transfer[now + 1], after[now + 1]), 1)
    ahead = np.empty((len(chain), BLOCK, n_lang))
    state = before
    for t in range(BLOCK):
        step = (state @ move) * emit[:, t]
        if t == 0:
            step[opening] = head * emit[opening, 0]
        state = np.where(live[:, t, None], norm(step, 1), state)
        ahead[:, t] = state
    state = after
    for t in range(BLOCK - 1, -1, -1):
        ahead[:, t] *= state
        state = np.where(live[:, t, None], norm((emit[:, t] * state) @ move.T, 1), state)
    return norm(ahead[live], 1)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    lexicon: frozenset

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Language probabilities (words by languages) of each word list."""
        if not self.languages:
            return [np.empty((len(t), 0)) for t in texts]
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        if not len(ids):
            return [np.empty((0, len(self.languages))) for _ in texts]
        scores = word_scores(list(number), self.weights, self.lexicon)
        some = sizes > 0
        found = marginals(scores[ids], sizes[some], self.transitions, self.start)
        return np.split(found, np.cumsum(sizes)[:-1])

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of every text."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        total = np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, list[str]]] = []
        size = 0

        def settle():
            for (i, _), p in zip(waiting, self.label([w for _, w in waiting])):
                total[i] += p.sum(0)
            waiting.clear()

        for i, text in enumerate(texts):
            for piece in pieces(text or ""):
                waiting.append((i, words_of(piece)))
                size += len(waiting[-1][1])
                if size >= BATCH_WORDS:
                    settle()
                    size = 0
        settle()
        for i, row in enumerate(total):
            if row.sum() > 0:
                best = int(row.argmax())
                langs[i], scores[i] = self.languages[best], float(min(1.0, row[best] / row.sum()))
        return langs, scores


def pieces(text: str):
    """A long text in pieces, parted at blanks."""
    at = 0
    while at < len(text):
        gap = re.compile(r"\s").search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop


def splice(texts: list[list[int]], labels: list[int], rng) -> tuple[np.ndarray, np.ndarray]:
    """Word and label sequences of ``SEQUENCE`` words from stretches in random order."""
    parts = []
    for words, label in zip(texts, labels):
        at = 0
        while at < len(words):
            size = int(rng.geometric(1 / STRETCH))
            parts.append((words[at:at + size], label))
            at += size
    order = rng.permutation(len(parts))
    words = np.array([w for i in order for w in parts[i][0]], np.int64)
    marks = np.array([parts[i][1] for i in order for _ in parts[i][0]], np.int64)
    n = max(1, len(words) // SEQUENCE)
    cut = min(len(words), n * SEQUENCE)
    return words[:cut].reshape(n, -1), marks[:cut].reshape(n, -1)


def fit(texts: list[str], langs: list[str], seed: int = 4) -> Model:
    """Train on whole labelled texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    split = [words_of(t) for t in texts]
    held: dict[str, int] = {}
    for t in split:
        for w in set(t):
            held[w] = held.get(w, 0) + 1
    lexicon = frozenset(w for w, n in held.items() if n >= LEXICON_TEXTS)
    n_lang = len(languages)
    model = Model(languages, np.zeros((FEATURES, n_lang)), np.zeros((n_lang, n_lang)), np.zeros(n_lang), lexicon)
    if not held or n_lang == 0:
        return Model([], model.weights, model.transitions, model.start, lexicon)
    vocabulary = {w: i for i, w in enumerate(held)}
    words, marks = splice([[vocabulary[w] for w in t] for t in split],
                          [languages.index(x) for x in langs], rng)
    owner, flat = features(list(vocabulary), lexicon)
    told = np.eye(n_lang)[marks]
    pairs = np.einsum("nti,ntj->ij", told[:, :-1], told[:, 1:])
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.transitions, model.start)]
    n = words.size
    for _ in range(STEPS):
        scores = np.stack([np.bincount(owner, model.weights[flat, k], len(vocabulary))
                           for k in range(n_lang)], 1)[words]
        emit = np.exp(scores - scores.max(2, keepdims=True))
        move = np.exp(model.transitions)
        ahead = np.empty_like(emit)
        state = np.exp(model.start) * emit[:, 0]
        for t in range(emit.shape[1]):
            state = state / state.sum(1, keepdims=True) if t == 0 else (state @ move) * emit[:, t]
            state = state / state.sum(1, keepdims=True)
            ahead[:, t] = state
        back = np.ones_like(state)
        expected = np.zeros_like(pairs)
        p = np.empty_like(emit)
        for t in range(emit.shape[1] - 1, -1, -1):
            both = ahead[:, t] * back
            p[:, t] = both / both.sum(1, keepdims=True)
            if t:
                into = emit[:, t] * back
                joint = ahead[:, t - 1, :, None] * move * into[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                back = into @ move.T
                back = back / back.sum(1, keepdims=True)
        slope = (told - p).reshape(-1, n_lang)
        per_word = np.stack([np.bincount(words.ravel(), slope[:, k], len(vocabulary)) for k in range(n_lang)], 1)
        up = [np.stack([np.bincount(flat, per_word[owner, k], FEATURES) for k in range(n_lang)], 1),
              pairs - expected, (told[:, 0] - p[:, 0]).sum(0)]
        for x, g, s in zip((model.weights, model.transitions, model.start), up, squares):
            g = g / n - 1e-6 * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, learnable: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the rows with a language for which ``learnable`` holds."""
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                      & F.length("text").between(1, MAX_CHARS))
    if learnable is not None:
        told = told.where(learnable)
    told = told.select("doc_id", "text", "lang", F.xxhash64(F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))).alias("turn"))
    # Per language the rows of the least hashes: the last of them first, without the texts.
    # Spark bounds both windows per language before it shuffles.
    n = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    last = told.select("lang", "turn", n.alias("n")).where(F.col("n") <= per_language) \
        .groupBy("lang").agg(F.max("turn").alias("last"))
    near = told.join(F.broadcast(last), "lang").where(F.col("turn") <= F.col("last"))
    n = F.row_number().over(Window.partitionBy("lang").orderBy("turn", F.xxhash64("text"), "text"))
    rows = near.select("lang", "turn", "text", n.alias("n")).where(F.col("n") <= per_language).collect()
    kept = sorted((r["lang"], r["turn"], r["text"]) for r in rows)
    return fit([r[2] for r in kept], [r[0] for r in kept])


def identified(text: Column, model: Model, spark) -> Column:
    """Struct column (lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.identify(list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return label(text)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; documents held out are not learned from."""
    model = train(docs, id_bucket(3) != 1)
    found = docs.select("doc_id", (id_bucket(3) == 1).alias("held_out"),
                        identified(F.col("text"), model, docs.sparkSession).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
