"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

**Kernel.** Two strings are as alike as the subsequences of ``ORDER`` letters they
share: one spread over ``s`` letters weighs ``DECAY ** s``, up to ``SPAN`` letters,
so inserted letters and gaps lower a match without losing it: with the decay near
one, and room for three letters in between, one letter costs little. Strings are
scaled by the square root of the weight their length can hold, those shorter than
``SHORT`` as that long, so that an inserted letter does not raise the scale.

**Strings.** A text is folded to letter classes (case, accents and look-alike
digits go; punctuation inside a word is passed over) and cut into words; three
or more single letters in a row are read as one word. Words longer than
``UNIT`` letters are read in overlapping windows. The sentence's, and the text's,
score is that of its strongest string.

**Training.** On the driver, on a bounded sample (``TOXIC_TEXTS`` and ``CLEAN_TEXTS``
documents, each at most ``MAX_CHARS`` long, the least by a hash of their ids) cut into
sentences that bear their document's label. Landmarks are the strings most tied
to the label, the clean strings most like them, and random others. The kernel
against the landmarks, whitened, gives each string its Nystroem features. As an
insult makes a sentence toxic but not all of a toxic document's sentences have
one, a squared-hinge SVM is trained on the strongest sentence of each toxic
document, and the strings that next to no clean document holds, against the
strongest sentences of the clean ones and random strings; the choice is repeated
with the model found, and a toxic document without a sentence stronger than most
clean documents have says nothing. A logistic curve gives the probability; it is
fitted to strongest scores of documents that took no part in the training, each
half of the sample scored by a model of the other half.

**Scoring.** The decision is linear in the landmarks' subsequence weights, so it
collapses into one weight per subsequence. A text is scored in one pass of array
lookups per gap pattern, whole and without a cache; memory is bounded by
``BLOCK_CHARS``, longer texts are read in blocks parted at blanks.

Defined results: NULL, empty and letterless texts get the score of a text
without any strong string; without labels of both classes every score is 0;
labels other than 0 and 1, and ids with contradicting labels, are not learned
from; repeated rows get equal scores; other columns are carried along.
"""

import re
import unicodedata
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import free_name, id_bucket

ORDER = 4
DECAY = 0.85
SPAN = 7
SHORT = 9
UNIT = 14
STEP = 7
TOXIC_TEXTS, CLEAN_TEXTS = 600, 1500
MAX_CHARS = 8_000
LANDMARKS = 256
ROUNDS = 4
ALIKE = 0.8                         # landmarks more alike than this add nothing
CERTAIN = 3.5                       # standard deviations that make a string's tie certain
MORE = 8                            # times as many toxic texts must hold it
CAUTION = 1.5                       # standard errors taken off a subsequence's tie
CLEAR = 0.80                        # share of clean texts a witness must be stronger than
HARDEST = 4                         # strongest strings of a clean text to train against
COST = 100.0
THRESHOLD = 0.3
BLOCK_CHARS = 1 << 20
BLOCK_STRINGS = 20_000              # of the sample that are weighed at once
SEQUENCES = 32 ** ORDER             # a subsequence of letter classes below 32 as a number
BLANK = 255
# Digits and signs read as the letters they resemble.
LOOKS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SENTENCE_ENDS = [ord(c) for c in ".!?\n"]
_GAP = re.compile(r"\s")


@cache
def classes() -> np.ndarray:
    """Letter class by code point: a-z are 1..26, other letters 27, passed over 0."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x30000):
        char = chr(code)
        if char.isspace():
            table[code] = BLANK
            continue
        base = LOOKS.get(char) or unicodedata.normalize("NFKD", char)[:1].lower()
        if "a" <= base <= "z":
            table[code] = ord(base) - 96
        elif char.isalpha():
            table[code] = 27
    return table


# Places of a subsequence's letters after its first, for every spread up to SPAN.
PATTERNS = [(*inner, last) for last in range(ORDER - 1, SPAN)
            for inner in combinations(range(1, last), ORDER - 2)]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter classes of a text without blanks, and start and length of its words."""
    kinds = classes()[codes]
    kinds = kinds[kinds > 0]
    blank = kinds == BLANK
    letters = kinds[~blank]
    ends = np.unique(np.append(np.flatnonzero(blank) - np.arange(blank.sum()), len(letters)))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    keep = ends > starts
    starts, sizes = starts[keep], (ends - starts)[keep]
    single = sizes == 1
    if single.any():                          # runs of three or more single letters
        edge = np.flatnonzero(np.diff(np.concatenate(([0], single.view(np.int8), [0]))))
        first, stop = edge[::2], edge[1::2]
        long = stop - first >= 3
        drop = np.zeros(len(sizes), bool)
        for a, b in zip(first[long], stop[long]):
            sizes[a] = b - a
            drop[a + 1:b] = True
        starts, sizes = starts[~drop], sizes[~drop]
    return letters, starts, sizes


def units(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the strings scored: words, long ones in overlapping windows, and
    neighbouring words that together are no longer than a window."""
    both = sizes[:-1] + sizes[1:]
    near = np.flatnonzero((both <= UNIT) & (starts[:-1] + sizes[:-1] == starts[1:]))
    single = _windows(starts, sizes)
    return np.concatenate([single[0], starts[near]]), np.concatenate([single[1], both[near]])


def _windows(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, those longer than ``UNIT`` in overlapping windows."""
    extra = np.where(sizes > UNIT, -(-(sizes - UNIT) // STEP), 0)
    if not extra.any():
        return starts, sizes
    word = np.repeat(np.arange(len(starts)), extra + 1)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    begin = np.minimum(turn * STEP, np.maximum(0, sizes[word] - UNIT))
    return starts[word] + begin, np.minimum(sizes[word] - begin, UNIT)


def scale(sizes: np.ndarray) -> np.ndarray:
    """Square root of the squared weights a string of each length can hold; strings shorter
    than ``SHORT`` count as that long, lest one shared subsequence decide."""
    sizes = np.maximum(sizes, SHORT)
    total = np.zeros(len(sizes))
    for *_, last in PATTERNS:
        total += np.maximum(0, sizes - last) * DECAY ** (2 * (last + 1))
    return np.sqrt(np.maximum(total, 1e-12))


@cache
def _scale_of(size: int) -> float:
    return float(scale(np.array([size]))[0])


def unit_scores(letters, starts, sizes, weights: np.ndarray) -> np.ndarray:
    """For every string the sum over its subsequences of ``weights``, scaled."""
    total = np.zeros(len(starts))
    shifted = [letters.astype(np.int32) << (5 * (ORDER - 1 - k)) for k in range(ORDER)]
    for last in range(ORDER - 1, min(SPAN, len(letters))):
        n = len(letters) - last
        value = np.zeros(n, weights.dtype)
        for pattern in (p for p in PATTERNS if p[-1] == last):
            key = shifted[0][:n].copy()
            for k, at in enumerate(pattern, 1):
                key += shifted[k][at:at + n]
            value += weights[key]
        sums = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
        first = np.minimum(starts, n)
        stop = np.clip(starts + sizes - last, first, n)
        total += DECAY ** (last + 1) * (sums[stop] - sums[first])
    return total / scale(sizes)


def subsequences(string: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The subsequences of one string and their scaled weights, repeats included."""
    codes = np.frombuffer(string, np.uint8).astype(np.int64)
    keys, weights = [np.empty(0, np.int64)], [np.empty(0)]
    for pattern in PATTERNS:
        n = len(codes) - pattern[-1]
        if n > 0:
            key = codes[:n] << (5 * (ORDER - 1))
            for k, at in enumerate(pattern, 1):
                key = key + (codes[at:at + n] << (5 * (ORDER - 1 - k)))
            keys.append(key)
            weights.append(np.full(n, DECAY ** (pattern[-1] + 1)))
    return np.concatenate(keys), np.concatenate(weights) / _scale_of(len(codes))


def strongest(text: str, weights: np.ndarray) -> float:
    """The largest string score of a text (0 if none is above)."""
    best, at = 0.0, 0
    while at < len(text):
        stop = at + BLOCK_CHARS
        if stop < len(text):              # to the next blank, so that no word is cut
            gap = _GAP.search(text, stop)
            stop = gap.start() if gap else len(text)
        letters, starts, sizes = words(codes_of(text[at:stop]))
        starts, sizes = units(starts, sizes)
        if len(starts):
            best = max(best, float(unit_scores(letters, starts, sizes, weights).max()))
        # the last word is read again, as it may belong to the next block's first
        *before, last = text[at:stop].rsplit(None, 1) or [""]
        at = stop - len(last) if before and stop < len(text) and len(last) < BLOCK_CHARS else stop
    return best


@dataclass
class Model:
    """One weight per subsequence, and the logistic curve over a text's strongest score."""

    weights: np.ndarray
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        margin = self.slope * strongest(text or "", self.weights) + self.offset
        return float(1 / (1 + np.exp(-margin))) if margin > -700 else 0.0


class Sample:
    """The sample's distinct strings and, per occurrence, its text, sentence and string."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        text, sentence, which = [], [], []
        sentences = 0
        for t, body in enumerate(texts):
            codes = codes_of(body)
            kinds = classes()[codes]
            letters, starts, sizes = words(codes)
            starts, sizes = units(starts, sizes)
            places = np.flatnonzero((kinds > 0) & (kinds != BLANK))[starts]
            ends = np.flatnonzero(np.isin(codes, SENTENCE_ENDS))
            inside = sentences + np.searchsorted(ends, places)
            sentences += len(ends) + 1
            raw, kept = letters.tobytes(), sizes >= ORDER
            which.append(np.array([number.setdefault(raw[a:a + n], len(number)) for a, n in
                                   zip(starts[kept].tolist(), sizes[kept].tolist())], np.int64))
            sentence.append(inside[kept])
            text.append(np.full(len(which[-1]), t))
        self.strings = list(number)
        self.text, self.sentence, self.which = (
            np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (text, sentence, which))
        self.letters = np.frombuffer(b"".join(self.strings), np.uint8)
        self.sizes = np.array([len(s) for s in self.strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def blocks(self):
        """The strings a block at a time: number of the first, and their letters, starts and sizes."""
        for first in range(0, len(self.strings), BLOCK_STRINGS):
            starts, sizes = (x[first:first + BLOCK_STRINGS] for x in (self.starts, self.sizes))
            letters = self.letters[starts[0]:starts[-1] + sizes[-1]]
            yield first, letters, starts - starts[0], sizes

    def strengths(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([unit_scores(letters, starts, sizes, weights)
                               for _, letters, starts, sizes in self.blocks()])

    def held_by(self, chosen: np.ndarray) -> np.ndarray:
        """Number of the chosen texts that hold each string."""
        rows = chosen[self.text]
        pairs = np.unique(self.text[rows] * len(self.strings) + self.which[rows])
        return np.bincount(pairs % len(self.strings), minlength=len(self.strings))

    def strongest(self, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, rank in its text, and strongest string of every sentence."""
        order = np.lexsort((-strength[self.which], self.sentence))
        first = order[np.append(True, np.diff(self.sentence[order]) > 0)]
        text, which = self.text[first], self.which[first]
        order = np.lexsort((-strength[which], text))
        text, which = text[order], which[order]
        return text, np.arange(len(text)) - np.searchsorted(text, text), which


def _ties(sample: Sample, held: list[np.ndarray], n: list[int]) -> np.ndarray:
    """A first weight per subsequence: how much more often toxic texts hold its strings."""
    both = [np.zeros(SEQUENCES), np.zeros(SEQUENCES)]
    for first, letters, starts, sizes in sample.blocks():
        letters = letters.astype(np.int64)
        string = first + np.repeat(np.arange(len(sizes)), sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(letters))
        for pattern in PATTERNS:
            at = np.flatnonzero(left > pattern[-1])
            key = letters[at] << (5 * (ORDER - 1))
            for k, gap in enumerate(pattern, 1):
                key += letters[at + gap] << (5 * (ORDER - 1 - k))
            for k in (0, 1):
                both[k] += np.bincount(key, held[k][string[at]], SEQUENCES)
    ratio = np.log((both[1] + .5) / (n[1] + 1)) - np.log((both[0] + .5) / (n[0] + 1))
    error = np.sqrt(1 / (both[1] + .5) + 1 / (both[0] + .5))
    return np.maximum(0, ratio - CAUTION * error) * (both[1] > 1)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights and offset of a squared-hinge SVM, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])

    def loss(w):
        return w @ ridge @ w + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2

    for _ in range(60):
        active = y * (x @ w) < 1
        xa, ca = x[active], cost[active]
        step = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active]) - w
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:      # the active rows changed too much
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-7:
            break
    return w


def _logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly smoothed logistic curve."""
    positives = y.sum()
    target = np.where(y > 0, (positives + 1) / (positives + 2), 1 / (len(y) - positives + 2))
    x = np.stack([s, np.ones_like(s)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2),
                               x.T @ (target - p) - 1e-4 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], toxic: list[int], seed: int = 8) -> Model:
    """Train on whole labelled texts.

    The logistic curve is fitted to scores of texts that took no part in the training:
    each half of the sample is scored by a model of the other half.
    """
    y = np.array(toxic, np.int64)
    rng = np.random.default_rng(seed)
    half = np.zeros(len(y), np.int64)
    for k in (0, 1):
        of_kind = np.flatnonzero(y == k)
        half[rng.permutation(of_kind)[:len(of_kind) // 2]] = 1
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return Model(np.zeros(SEQUENCES, np.float32), 0.0, -800.0)
    best = np.zeros(len(y))
    for k in (0, 1):
        rest = np.flatnonzero(half != k)
        weights, bias = learn([texts[i] for i in rest], y[rest], seed)
        for i in np.flatnonzero(half == k):
            best[i] = strongest(texts[i], weights) + bias
    slope, offset = _logistic(best, y.astype(float))
    weights, bias = learn(texts, y, seed)
    return Model(weights, max(0.0, slope), offset + max(0.0, slope) * bias)


def learn(texts: list[str], y: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weight per subsequence and offset of the support vector machine."""
    rng = np.random.default_rng(seed)
    sample = Sample(texts)
    if not sample.strings:
        return np.zeros(SEQUENCES, np.float32), 0.0
    n = [int((y == k).sum()) for k in (0, 1)]
    held = [sample.held_by(y == k) for k in (0, 1)]
    weights = _ties(sample, held, n)
    strength = sample.strengths(weights)
    # Strings that far more toxic than clean texts hold are insults whoever else is near.
    expected = held[0] * (n[1] / n[0])
    sure = np.flatnonzero((held[1] - expected > CERTAIN * np.sqrt(held[1] + expected))
                          & (held[1] > MORE * (expected + 1)))

    tied = np.flatnonzero((held[1] > 0) & (held[0] == 0))
    clean = np.flatnonzero(held[0] > 0)
    landmarks: list[int] = []
    vectors: list[dict] = []
    for wanted, pool in (
            (LANDMARKS // 2, np.concatenate([sure[np.argsort(-held[1][sure], kind="stable")],
                                             tied[np.argsort(-strength[tied], kind="stable")]])),
            (LANDMARKS * 3 // 4, clean[np.argsort(-strength[clean], kind="stable")]),
            (LANDMARKS, rng.permutation(clean))):
        for i in pool:
            if len(landmarks) >= wanted:
                break
            vector: dict[int, float] = {}
            for key, weight in zip(*(x.tolist() for x in subsequences(sample.strings[i]))):
                vector[key] = vector.get(key, 0.0) + weight
            own = sum(w * w for w in vector.values())
            if all(sum(w * other[k] for k, w in vector.items() if k in other) < ALIKE * np.sqrt(
                    own * sum(w * w for w in other.values())) for other in vectors):
                landmarks.append(int(i))
                vectors.append(vector)
    known = np.unique([k for vector in vectors for k in vector])
    place = np.full(SEQUENCES, -1, np.int32)
    place[known] = np.arange(len(known))
    base = np.zeros((len(vectors), len(known)))
    for row, vector in zip(base, vectors):
        row[place[list(vector)]] = list(vector.values())
    value, vector = np.linalg.eigh(base @ base.T)
    sound = value > 1e-6 * value.max()
    whiten = vector[:, sound] / np.sqrt(value[sound])

    features: dict[int, np.ndarray] = {}

    def nystroem(chosen):
        for i in chosen:
            if i not in features:
                keys, weight = subsequences(sample.strings[i])
                at = place[keys]
                features[i] = (base[:, at[at >= 0]] @ weight[at >= 0] @ whiten).astype(np.float32)
        return np.array([features[i] for i in chosen], np.float64)

    bias = 0.0
    for _ in range(ROUNDS):
        text, rank, which = sample.strongest(strength)
        top = strength[which]
        # a toxic text without a sentence stronger than most clean texts' says nothing
        clear = top > np.quantile(top[(rank == 0) & (y[text] == 0)], CLEAR) if (y[text] == 0).any() else top > 0
        witness = which[(rank == 0) & (y[text] == 1) & clear]
        hard = which[(rank < HARDEST) & (y[text] == 0)]
        loose = rng.choice(clean, min(len(clean), len(hard)), replace=False)
        against = np.setdiff1d(np.concatenate([hard, loose]), sure)
        kinds = np.union1d(np.setdiff1d(witness, against), sure)
        if not len(kinds):
            return np.zeros(SEQUENCES, np.float32), 0.0
        chosen = np.concatenate([kinds, against])
        labels = np.concatenate([np.ones(len(kinds)), -np.ones(len(against))])
        solved = _svm(nystroem(chosen.tolist()), labels, np.full(len(labels), COST))
        weights, bias = np.zeros(SEQUENCES), float(solved[-1])
        weights[known] = base.T @ (whiten @ solved[:-1])
        strength = sample.strengths(weights)
    return weights.astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, learnable: Column | None = None,
          most: tuple[int, int] = (CLEAN_TEXTS, TOXIC_TEXTS), max_chars: int = MAX_CHARS) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``learnable`` holds."""
    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if learnable is not None:
        told = told.where(learnable)
    told = told.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")) \
        .where("toxic = most").select("doc_id", "toxic", F.xxhash64("doc_id").alias("turn"))
    ids = [row for k in (0, 1) for row in
           told.where(F.col("toxic") == k).orderBy("turn", "doc_id").limit(most[k]).collect()]
    if not ids:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in ids],
                                               "chosen BIGINT, toxic INT")
    # at most sum(most) ids: a broadcast of a set size
    found = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in
                  found.select("doc_id", "text", "toxic").limit(sum(most)).collect())
    return fit([r[1] for r in rows], [r[2] for r in rows])


def toxicity(text: Column, model, spark) -> Column:
    """Score column (0 to 1) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        fitted = shared.value
        return pd.Series([fitted.score(t) for t in texts], dtype="float64")

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored below ``THRESHOLD``, all columns kept."""
    name = free_name(docs, "toxicity")
    scored = docs.withColumn(name, toxicity(F.col("text"), train(docs, labels), docs.sparkSession))
    return scored.where(F.col(name) < THRESHOLD).select(*docs.columns)


def toxic_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and verdict; documents held out are not learned from."""
    model = train(docs, labels, id_bucket(4) != 2)
    return docs.select("doc_id", (id_bucket(4) == 2).alias("held_out"),
                       toxicity(F.col("text"), model, docs.sparkSession).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
