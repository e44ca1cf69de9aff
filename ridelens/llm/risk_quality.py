"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose measure exceeds a cutoff. A cutoff may be used
only if the labelled holdout shows that the rule falsely rejects few good
documents: the exact (Clopper-Pearson) upper bound of the false-rejection rate
must not exceed ``RISK``. With probability ``1 - ERROR`` every chosen cutoff keeps
its promise in the group it was certified in. ``RISK`` is per rule and group, so a
good document is rejected by any of r rules with probability at most ``r * RISK``.

Cutoffs are tested in an order fixed beforehand, from the loosest on, until one
fails. Such a sequence needs no correction for its length: a cutoff that breaks
the promise is passed only if the first of those is, one test at the sequence's
level. The correction is for the number of sequences: one per rule and stratum and
one per rule and length band share a tenth of ``ERROR`` each; the rest goes to one
sequence over all documents, whose steps take the rules in turn. A stratum too thin
to certify a cutoff of a rule takes that of its band, else that of all documents
(the promise is then the larger group's).

The holdout is every labelled document (label 1 = good), counted by Spark into
one row per stratum: how many good documents, and how many of them each cutoff
rejects. The candidate cutoffs are a fixed grid, chosen without the labels, so
that the exact bounds hold. Strata are bands of text length and the language
label, any number of them: each gets its cutoffs in the task that holds its counts,
and documents are joined to them by stratum; only the bands' sums come to the driver.
Documents of a stratum without a labelled good one pass all rules.

Measures (words are runs of anything but the six ASCII blanks): share of
symbols, of lines that repeat an earlier one, of words in repeated five-word
windows, shortness, and mean word length off the usual.

Defined results: a NULL or empty text has no words and fails the base rule;
labels other than 0 and 1 and contradicting labels of one id are not used;
without labels only the base rule rejects; repeated rows get equal results;
columns other than the id, text and language are not read. Texts of any length
are measured whole, a line or a window at a time.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage
from ridelens.session import written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
RISK = 0.01
ERROR = 0.05
# Shares of ERROR: sequences per stratum, per length band, over all documents.
SHARES = (0.1, 0.1, 0.8)
# The sequence over all documents takes these rules in turn, then the next group:
# short texts are often good ones, so their rule must not end the others' steps.
TURNS = (("symbols", "dup_lines", "repeat_words", "word_length"), ("shortness",))
# Upper ends of the length bands, in words.
LENGTH_BANDS = (50, 200, 1000)
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, " \
           "n_repeat_words bigint, n_lines bigint"
# Rule name and candidate cutoffs, strictest first.
RULES = {
    "symbols": tuple(i / 100 for i in range(1, 51)),
    "dup_lines": tuple(i / 50 for i in range(1, 50)),
    "repeat_words": tuple(i / 100 for i in range(1, 21)),
    "shortness": tuple(1 / n for n in (100, 80, 60, 50, 40, 30, 25, 20, 15, 12)),
    "word_length": tuple(i / 4 for i in range(2, 41)),
}
USUAL_WORD = 5.5


def measured(body: bytes) -> tuple[int, int, int, int, int, int]:
    """The measures of a text in UTF-8, in the order of ``MEASURES``."""
    words = body.split()                       # at the six ASCII blanks
    blanks = len(body) - sum(map(len, words))
    chars = len(body.decode("utf-8", "replace")) - blanks
    symbols = len(body) - len(body.translate(None, SYMBOLS))
    seen, dup_lines, n_lines = set(), 0, 0
    for line in body.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    return len(words), chars, symbols, dup_lines, repeated_words(words), n_lines


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    n, base = len(ids) - WINDOW + 1, len(number)
    code = ids[:n]                             # one whole number per window, without collisions
    for k in range(1, WINDOW):
        if int(code.max()) >= 2 ** 62 // base:
            code = np.unique(code, return_inverse=True)[1]
        code = code * base + ids[k:k + n]
    _, which, count = np.unique(code, return_inverse=True, return_counts=True)
    if len(count) == n:
        return 0
    inside = np.zeros(len(ids), bool)
    for k in range(WINDOW):
        inside[k:k + n] |= count[which] > 1
    return int(inside.sum())


def measures_of(text: Column) -> Column:
    """Struct column of the measures of a text column."""
    @F.pandas_udf(MEASURES)
    def measure(bodies: pd.Series) -> pd.DataFrame:
        names = [part.split()[0] for part in MEASURES.split(", ")]
        return pd.DataFrame([measured(b) for b in bodies], columns=names)

    return measure(F.coalesce(text, F.lit("")).cast("binary"))


def risk_columns() -> dict[str, Column]:
    """The value each rule compares with its cutoff."""
    words = F.col("n_words")
    return {
        "symbols": F.try_divide(F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_words": F.try_divide(F.col("n_repeat_words"), words),
        "shortness": F.try_divide(F.lit(1), words),
        "word_length": F.abs(F.try_divide(F.col("word_chars"), words) - USUAL_WORD),
    }


def stratum() -> Column:
    """Length band and language of a measured row."""
    band = F.lit(len(LENGTH_BANDS))
    for k in reversed(range(len(LENGTH_BANDS))):
        band = F.when(F.col("n_words") < LENGTH_BANDS[k], k).otherwise(band)
    return F.concat_ws(":", band.cast("string"), F.coalesce("lang", F.lit("")))


def binomial_tail(n: int, k: int, p: float) -> float:
    """Probability of at most ``k`` successes in ``n`` trials."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    term = n * math.log1p(-p)
    terms = [term]
    for i in range(1, k + 1):
        term += math.log((n - i + 1) / i) + math.log(p) - math.log1p(-p)
        terms.append(term)
    most = max(terms)
    return min(1.0, math.exp(most) * math.fsum(math.exp(t - most) for t in terms))


def certified(n: int, rejected: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound of the rejection rate at level ``error`` is at most
    ``risk``: so few rejections would have probability ``error`` or less at that rate."""
    return n > 0 and rejected < n and binomial_tail(n, rejected, risk) <= error


def choose(counts: dict[str, dict], risk: float = RISK, error: float = ERROR,
           rules: dict[str, tuple] = RULES, groups: int | None = None) -> dict[str, dict[str, float]]:
    """Cutoff per stratum and rule, from ``counts[stratum] = {"n": good documents, rule:
    rejected good documents per cutoff}``: the strictest before the first that fails, from
    the loosest on. A rule whose loosest cutoff fails is left out. ``groups`` is the number
    of all strata, if ``counts`` holds some of them."""
    level = error / max(1, len(rules) * (groups or len(counts)))
    chosen: dict[str, dict[str, float]] = {name: {} for name in counts}
    for name, seen in counts.items():
        for rule, cutoffs in rules.items():
            for cutoff, rejected in reversed(list(zip(cutoffs, seen[rule]))):
                if not certified(seen["n"], rejected, risk, level):
                    break
                chosen[name][rule] = cutoff
    return chosen


def choose_in_turn(seen: dict, risk: float, error: float, rules: dict[str, tuple] = RULES) -> dict[str, float]:
    """Cutoff per rule from a single sequence at the whole level: the loosest cutoffs of the
    rules that take turns first, then as far into each grid as into the others, then the
    next group's; it ends at the first that fails."""
    steps = sorted((group, 1 - (i + 1) / len(rules[rule]), rules[rule][i], seen[rule][i], rule)
                   for group, turn in enumerate(TURNS) for rule in turn for i in range(len(rules[rule])))
    chosen = {}
    for *_, cutoff, rejected, rule in steps:
        if not certified(seen["n"], rejected, risk, error):
            break
        chosen[rule] = cutoff
    return chosen


def _pooled(counts: list[dict], rules: dict[str, tuple] = RULES) -> dict:
    return {"n": sum(c["n"] for c in counts),
            **{rule: [sum(x) for x in zip(*(c[rule] for c in counts))] for rule in rules}}


def _larger_groups(bands: dict[str, dict], risk: float, error: float) -> dict[str, dict[str, float]]:
    """Cutoffs per band for its strata without their own: the band's, else those of all documents."""
    of_band = choose(bands, risk, error * SHARES[1])
    of_all = choose_in_turn(_pooled(list(bands.values())), risk, error * SHARES[2])
    return {band: of_all | own for band, own in of_band.items()}


def choose_backed(counts: dict[str, dict], risk: float = RISK, error: float = ERROR) -> dict[str, dict[str, float]]:
    """Cutoffs of every stratum ``band:language``: its own where certified, else its band's,
    else those of all documents."""
    if not counts:
        return {}
    bands: dict[str, list] = {}
    for name, seen in counts.items():
        bands.setdefault(name.split(":")[0], []).append(seen)
    larger = _larger_groups({band: _pooled(seen) for band, seen in bands.items()}, risk, error)
    own = choose(counts, risk, error * SHARES[0])
    return {name: larger[name.split(":")[0]] | own[name] for name in counts}


def calibrate(measures: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``stratum, cutoffs`` (a map from rule to cutoff) of every stratum with labelled good
    documents that pass the base rule: :func:`choose_backed`, a batch of strata at a time."""
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("least"), F.max("quality").alias("most"))
    good = measures.join(told.where("least = 1 and most = 1").select("doc_id"), "doc_id", "left_semi") \
        .where(~F.col("base_failed"))
    values = risk_columns()
    counts = cut_lineage(good.select(stratum().alias("stratum"), *[v.alias(k) for k, v in values.items()])
                         .groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.array(*[F.count_if(F.col(rule) > c) for c in cutoffs]).alias(rule)
          for rule, cutoffs in RULES.items()]))
    pooled = counts.groupBy(F.split_part("stratum", F.lit(":"), F.lit(1)).alias("band")).agg(
        F.count(F.lit(1)).alias("strata"), F.sum("n").alias("n"),
        *[F.array(*[F.sum(F.col(rule)[i]) for i in range(len(cutoffs))]).alias(rule)
          for rule, cutoffs in RULES.items()]).collect()
    groups = sum(r.strata for r in pooled)
    larger = _larger_groups({r.band: r.asDict() for r in pooled}, risk, error) if pooled else {}

    def chosen(batches):
        for batch in batches:
            seen = {r["stratum"]: r for r in batch.to_dict("records")}
            own = choose(seen, risk, error * SHARES[0], groups=groups)
            yield pd.DataFrame({"stratum": list(seen), "cutoffs": [
                larger[name.split(":")[0]] | own[name] for name in seen]})

    return counts.mapInPandas(chosen, "stratum string, cutoffs map<string,double>")


def measured_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the measures and the base rule's verdict of every row."""
    rows = docs.select("doc_id", "lang", measures_of(F.col("text")).alias("m")).select("doc_id", "lang", "m.*")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def verdict(cutoffs: Column) -> Column:
    """Whether a measured row passes the base rule and its stratum's cutoffs (NULL: none)."""
    rejected = F.lit(False)
    for rule, value in risk_columns().items():
        rejected = rejected | F.coalesce(value > F.try_element_at(cutoffs, F.lit(rule)), F.lit(False))
    return ~F.col("base_failed") & ~rejected


def quality_report(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Per document its measures, the base rule's verdict, and whether it is kept."""
    rows = cut_lineage(measured_rows(docs))
    # written: of a table of known size Spark sees whether it can be sent to all tasks
    cutoffs = written(calibrate(rows, labels, **limits), "cutoffs")
    return rows.withColumn("stratum", stratum()).join(cutoffs, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", verdict(F.col("cutoffs")).alias("kept"))
