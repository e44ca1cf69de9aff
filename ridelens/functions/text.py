"""Phrase matching on text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a meaning in Java and RE2 patterns outside character classes.
_REGEX_META = set("\\.^$|?*+()[]{}")

# The non-ASCII letters that match an ASCII letter under
# case-insensitive Unicode matching, and the letter each one stands for
# (dotted capital I, long s, dotless i). The Kelvin sign lower-cases to 'k'.
FOLD_FROM = "İſı"
FOLD_TO = "isi"


def literal_pattern(phrase: str) -> str:
    """The phrase as a regex matching itself (metacharacters escaped); valid in
    Java (Spark) and RE2 (DuckDB) alike."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in phrase)


def alternation(phrases: Sequence[str]) -> str:
    """``(?:p1|p2|...)`` over the escaped phrases."""
    return "(?:" + "|".join(literal_pattern(p) for p in phrases) + ")"


def fold_case(text: str | Column) -> Column:
    """Text in which a substring equals a lower-cased ASCII phrase exactly when
    the original contains the phrase ignoring case (Unicode simple folding, as
    a case-insensitive regex would match it): the three letters whose case
    partner is ASCII but which lower-case to something else are mapped first,
    then everything is lower-cased (one character each, so nothing shifts)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def _is_ascii(phrase: str) -> bool:
    return all(ord(ch) < 128 for ch in phrase)


def sql_string(value: str) -> str:
    """A Spark SQL string literal (backslash and quote escaped)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A back-quoted Spark SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def contains_any_sql(folded: str, phrases: Sequence[str]) -> str:
    """SQL boolean: the case-folded text column (see :func:`fold_case`)
    contains one of the phrases, ignoring case; no phrases, no match. ASCII
    phrases use a plain substring search; others fall back to a ``(?iu)`` regex
    on the same text."""
    col = sql_name(folded)
    tests = [f"contains({col}, {sql_string(p.lower())})" for p in phrases if _is_ascii(p)]
    other = [p for p in phrases if not _is_ascii(p)]
    if other:
        tests.append(f"{col} RLIKE {sql_string('(?iu)' + alternation(other))}")
    return "(" + " OR ".join(tests or ["false"]) + ")"


MASK_BITS = 62


def phrase_mask(folded: str, groups: Sequence[Sequence[str]]) -> Column:
    """BIGINT with bit i set when the folded text column contains a phrase of
    ``groups[i]`` (ignoring case); a NULL text gives 0. One column holds every
    flag, so the substring searches run once per row however many flags are
    read from it. Built as one SQL expression (one call into the JVM)."""
    if len(groups) > MASK_BITS:
        raise ValueError(f"at most {MASK_BITS} phrase groups per mask")
    terms = [f"CASE WHEN {contains_any_sql(folded, phrases)} THEN {1 << i}L ELSE 0L END"
             for i, phrases in enumerate(groups)]
    return F.expr(" + ".join(terms) if terms else "0L")


def mask_bit_sql(mask: str, i: int) -> str:
    """Bit i of a :func:`phrase_mask` column as INT 0/1 (SQL)."""
    return f"CAST(shiftright({sql_name(mask)}, {i}) & 1L AS INT)"


def any_phrase(text: str | Column, phrases: Sequence[str]) -> Column:
    """1 if the text contains any phrase as a substring, ignoring case with
    Unicode folding; 0 otherwise, including for a NULL text. For one-off use;
    :func:`phrase_mask` serves many phrase groups in one pass."""
    text = F.col(text) if isinstance(text, str) else text
    folded = fold_case(text)
    tests = [folded.contains(p.lower()) for p in phrases if _is_ascii(p)]
    other = [p for p in phrases if not _is_ascii(p)]
    if other:
        tests.append(folded.rlike("(?iu)" + alternation(other)))
    cond = F.lit(False)
    for t in tests:
        cond = cond | t
    return F.coalesce(cond, F.lit(False)).cast("int")


def phrase_occurrences_sql(text: str, phrase: str) -> str:
    """SQL BIGINT: non-overlapping occurrences of ``phrase`` in the text column
    (case-sensitive), 0 for a NULL text. Byte lengths make the count
    independent of how characters are counted; ``replace`` returns its input
    untouched when the phrase is absent, so a miss costs one search, no copy."""
    if not phrase:
        raise ValueError("empty phrase")
    col = sql_name(text)
    width = len(phrase.encode("utf-8"))
    return (f"coalesce((octet_length({col}) - octet_length(replace({col}, "
            f"{sql_string(phrase)}, ''))) div {width}, 0L)")


def phrase_occurrences(text: str, phrase: str) -> Column:
    """Column form of :func:`phrase_occurrences_sql`."""
    return F.expr(phrase_occurrences_sql(text, phrase))
