"""Dictionary-based aspect and sentiment labelling of review text.

Flags, labels and counts are column expressions evaluated inside one
projection or one aggregate per task; nothing is exploded per phrase and no
Python runs per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelens.functions.text import (MASK_BITS, fold_case, mask_bit_sql, phrase_mask,
                                     phrase_occurrences_sql, sql_name, sql_string)
from ridelens.functions.trie import doubles, trie_pattern

# The default keyword dictionary (aspect -> sentiment -> phrases),
# in the order the analysis defines it. Phrase order breaks ties in the top-k.
DEFAULT_DICTIONARY: dict[str, dict[str, list[str]]] = {
    "app": {
        "positive": ["unmatched", "go-to", "user_friendly", "convenience", "easy"],
        "satisfactory": ["could be better", "glitches", "could have been more precise",
                         "could be more accurate", "decent", "was not accurate"],
        "negative": ["constant glitches", "incorrect arrival time",
                     "incorrect arrival times", "crashed repeatedly"],
    },
    "driver": {
        "positive": ["courteous", "polite", "professional", "knowledgeable", "punctual",
                     "friendly"],
        "satisfactory": ["could have been better", "communication problems"],
        "negative": ["unfamiliar", "got lost", "a bit unfriendly", "rude", "difficult",
                     "recklessly", "disinterested", "explanation", "inexperienced", "poor",
                     "unprofessional", "disrespectful", "distracted", "disgusted",
                     "horrible"],
    },
    "ride": {
        "positive": ["on time", "highly", "good", "smooth", "hassle-free", "go-to",
                     "Great service!", "efficient", "safe", "promptly", "reliable",
                     "convenience", "unmatched", "comfortable", "clean"],
        "satisfactory": ["fine", "longer", "would be helpful"],
        "negative": ["weird", "strange", "not as clean", "not in the best condition",
                     "regrettable", "uncomfortable", "unpleasant", "not clean", "not a great",
                     "disgusted", "broke down", "unsafe", "wrong", "terrible", "worst"],
    },
    "price": {
        "positive": ["saves", "quickly", "affordable"],
        "satisfactory": ["increased", "higher than expected"],
        "negative": ["overcharged"],
    },
    "wait_time": {
        "positive": ["promptly"],
        "satisfactory": ["preferred"],
        "negative": ["stranded", "late", "incorrect", "wrong", "last minute"],
    },
}
Dictionary = Mapping[str, Mapping[str, Sequence[str]]]

# Every aspect and sentiment comes from the dictionary in use: label columns in its
# order, flag columns by aspect name, labels by the sentiments' order in the aspect.
SENTIMENTS = ["positive", "satisfactory", "negative"]
LABEL_ASPECTS = list(DEFAULT_DICTIONARY)
FLAG_ASPECTS = sorted(DEFAULT_DICTIONARY)


def flag_entries(dictionary: Dictionary = DEFAULT_DICTIONARY) -> list[tuple[str, str]]:
    """``(aspect, sentiment)`` of every flag column, in column order."""
    return [(a, s) for a in sorted(dictionary) for s in dictionary[a]]


def flag_columns(dictionary: Dictionary = DEFAULT_DICTIONARY) -> list[str]:
    return [f"{a}_{s}" for a, s in flag_entries(dictionary)]


def dictionary_rows(dictionary: Dictionary = DEFAULT_DICTIONARY) -> list[tuple[str, str, int, str]]:
    """``(aspect, sentiment, pos, phrase)`` for every phrase, pos 1-based."""
    return [(a, s, i, p) for a, by_sent in dictionary.items()
            for s, phrases in by_sent.items() for i, p in enumerate(phrases, start=1)]


def keyword_flags(df: DataFrame, text_col: str = "review",
                  dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """One 0/1 column ``<aspect>_<sentiment>`` per dictionary entry: does
    the text contain any of its phrases (substring, any case)? NULL text -> 0,
    an entry without phrases -> 0.

    The text is case-folded once per row, all entries are searched into bit
    masks (one per 62 entries), and the flags are bits of them: three
    projections that Catalyst keeps apart because the folded text and the masks
    are read many times.
    """
    entries = flag_entries(dictionary)
    keep = [sql_name(c) for c in df.columns]
    folded = df.select("*", fold_case(F.col(text_col)).alias("_folded"))
    masks = [phrase_mask("_folded", [dictionary[a][s] for a, s in entries[i:i + MASK_BITS]])
             .alias(f"_mask{i // MASK_BITS}") for i in range(0, len(entries), MASK_BITS)]
    masked = folded.select(*[F.col(c) for c in df.columns], *masks)
    return masked.selectExpr(*keep, *[
        f"{mask_bit_sql(f'_mask{i // MASK_BITS}', i % MASK_BITS)} AS {sql_name(f'{a}_{s}')}"
        for i, (a, s) in enumerate(entries)])


def aspect_labels(df: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """C7 (first half): per aspect the first sentiment flagged in priority
    order (else ``''``) and ``<aspect>_val`` = 1 if labelled."""
    labels = []
    for a in dictionary:
        whens = " ".join(f"WHEN {sql_name(f'{a}_{s}')} = 1 THEN {sql_string(s)}"
                         for s in dictionary[a])
        labels.append((f"CASE {whens} ELSE '' END" if whens else "''") + f" AS {sql_name(a)}")
    out = df.selectExpr("*", *labels)
    vals = [e for a in dictionary
            for e in (sql_name(a), f"CAST({sql_name(a)} <> '' AS BIGINT) AS {sql_name(a + '_val')}")]
    return out.selectExpr(*[sql_name(c) for c in df.columns], *vals)


def classify_reviews(df: DataFrame, text_col: str = "review",
                     dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """Flags -> labels, then the flag columns dropped."""
    flagged = keyword_flags(df, text_col, dictionary)
    return aspect_labels(flagged, dictionary).drop(*flag_columns(dictionary))


def _unpivot_sql(rows: Sequence[Sequence[tuple[str, str]]]) -> str:
    """``inline(array(named_struct(...), ...))`` over (field, SQL expr) lists."""
    structs = ["named_struct(" + ", ".join(f"{sql_string(k)}, {v}" for k, v in row) + ")"
               for row in rows]
    return "inline(array(" + ", ".join(structs) + "))"


def flag_value_counts(flagged: DataFrame, flags: Sequence[str] | None = None) -> DataFrame:
    """``flag, value, n`` - frequency of each 0/1 value per flag column,
    values with no rows omitted. One pass of sums, then an unpivot of two rows a
    flag. ``flags`` are by default those of the default dictionary."""
    flags = list(flags or flag_columns())
    sums = flagged.selectExpr("count(1) AS _rows",
                              *[f"coalesce(sum({sql_name(c)}), 0L) AS _s{i}"
                                for i, c in enumerate(flags)])
    rows = []
    for i, c in enumerate(flags):
        rows.append([("flag", sql_string(c)), ("value", "1"), ("n", f"_s{i}")])
        rows.append([("flag", sql_string(c)), ("value", "0"), ("n", f"_rows - _s{i}")])
    return sums.selectExpr(_unpivot_sql(rows)).where(F.col("n") > 0)


def _distinct_phrases(dictionary: Dictionary) -> list[str]:
    return list(dict.fromkeys(p for *_, p in dictionary_rows(dictionary)))


def keyword_matches(df: DataFrame, text_col: str = "review",
                    dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """Per row: the other columns plus ``_found``, an array of (hit, whole, n) from one pass
    over the lower-cased text (dropped): a hit is the longest phrase at one place and stands
    for every phrase that starts it. Where two occurrences of a phrase overlap, an entry
    with ``whole`` false corrects that phrase's count to the non-overlapping one. Per-row,
    so it can run before any join and the join carries hits instead of texts."""
    phrases = _distinct_phrases(dictionary)
    twice = {p: doubles(p) for p in phrases}
    overlaps = [d for ds in twice.values() for d in ds]
    keep = [sql_name(c) for c in df.columns if c != text_col]
    lowered = df.select(*[F.col(c) for c in df.columns if c != text_col],
                        F.lower(F.col(text_col)).alias("_t"))
    kind = "array<struct<hit:string,whole:boolean,n:bigint>>"
    if not phrases:
        return lowered.selectExpr(*keep, f"CAST(array() AS {kind}) AS _found")
    pattern = sql_string(trie_pattern(phrases + overlaps))
    hits = lowered.selectExpr(*keep, "_t", f"coalesce(regexp_extract_all(_t, {pattern}, 1), array()) AS _hits")
    found = "transform(_hits, h -> named_struct('hit', h, 'whole', true, 'n', 1L))"
    if overlaps:
        starts = lambda p: f"startswith(h, {sql_string(p)})"
        fixes = ", ".join(
            f"named_struct('hit', {sql_string(p)}, 'whole', false, 'n', {phrase_occurrences_sql('_t', p)}"
            f" - size(filter(_hits, h -> {starts(p)})))" for p, ds in twice.items() if ds)
        # a doubled phrase is longer than any single start of it, so it shows in the hits
        doubled = " OR ".join(starts(d) for d in overlaps)
        found = f"CASE WHEN exists(_hits, h -> {doubled}) THEN concat({found}, array({fixes})) ELSE {found} END"
    return hits.selectExpr(*keep, f"CAST({found} AS {kind}) AS _found")


def keyword_totals(matched: DataFrame, dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """``aspect, sentiment, pos, phrase, n`` from :func:`keyword_matches` rows: the hits are
    counted per distinct hit (as few as the phrases), summed per phrase and unpivoted to one
    row per dictionary entry."""
    rows = dictionary_rows(dictionary)
    slot = {p: f"_k{i}" for i, p in enumerate(_distinct_phrases(dictionary))}
    # (the outer form: for the other one Spark adds a filter that searches the text again)
    per_hit = matched.select(F.inline_outer("_found")).groupBy("hit", "whole").agg(F.sum("n").alias("n"))
    totals = per_hit.selectExpr(*[
        f"coalesce(sum(CASE WHEN CASE WHEN whole THEN startswith(hit, {sql_string(p)})"
        f" ELSE hit = {sql_string(p)} END THEN n END), 0L) AS {k}" for p, k in slot.items()] or ["0 AS _none"])
    return totals.selectExpr(_unpivot_sql([
        [("aspect", sql_string(a)), ("sentiment", sql_string(s)), ("pos", str(i)),
         ("phrase", sql_string(p)), ("n", slot[p])] for a, s, i, p in rows]))


def keyword_counts(df: DataFrame, text_col: str = "review",
                   dictionary: Dictionary = DEFAULT_DICTIONARY) -> DataFrame:
    """C9 (counts): ``aspect, sentiment, pos, phrase, n`` - non-overlapping
    occurrences of each phrase in the lower-cased text, summed over all rows.

    The phrase itself is not lower-cased (so 'Great service!' counts 0). All phrases are
    found in one pass over each text, by one pattern compiled from a trie of them.
    """
    return keyword_totals(keyword_matches(df.select(text_col), text_col, dictionary), dictionary)


def top_keywords(counts: DataFrame, k: int = 5) -> DataFrame:
    """C9 (top-k): the k most frequent phrases per aspect and sentiment, ties
    in dictionary order, zero counts included. ``aspect, sentiment, rank,
    phrase, n``."""
    w = Window.partitionBy("aspect", "sentiment").orderBy(F.col("n").desc(), F.col("pos"))
    return counts.select("aspect", "sentiment", F.row_number().over(w).alias("rank"),
                         "phrase", "n").where(F.col("rank") <= k)


def sentiment_rollup(classified: DataFrame, time_cols: Sequence[str] = ("year", "month", "hour"),
                     aspects: Sequence[str] = LABEL_ASPECTS) -> DataFrame:
    """Rows with a NULL key dropped, grouped by calendar parts and the
    aspects' labels, with their ``_val`` sums; ordered by the keys. ``aspects``
    are those of the dictionary the labels were made with."""
    keys = [*time_cols, *aspects]
    # One IS NOT NULL per key, not dropna(): Catalyst folds the test to true
    # for the never-NULL labels instead of re-evaluating them below the
    # projection (dropna's atleastnnonnulls would inline the text search).
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return (classified.where(present).groupBy(*keys)
            .agg(*[F.sum(f"{a}_val").cast("bigint").alias(f"{a}_val") for a in aspects])
            .orderBy(*keys))
