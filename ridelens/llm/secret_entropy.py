"""Secret scanning with DataFrame functions only.

Two sources of spans:

* **patterns** - fixed shapes (key assignments, access ids, long hex strings),
  found leftmost and non-overlapping per kind;
* **entropy** - candidate strings (runs of 20 or more token characters with a
  digit) are classed by the narrowest character class that holds them (hex,
  alphanumeric, base64-like); a window slides over the candidate, the counts
  per character and the entropy sum are updated by the one character that
  enters and the one that leaves, and the candidate is reported from its first
  to its last window whose Shannon entropy reaches the class's threshold.
  Candidates matching the allow-list are suppressed.

Entropy is kept in whole micro-bits (``sum f(count)``, ``f(c) = c log2 c``), so
the verdict does not depend on floating-point order.

Spans are in code points, end exclusive. A NULL or empty text has no span; text
length is not limited (matches never cross a line break, the state per
candidate is one count per alphabet character). Rows are independent, so
repeated rows give repeated results and extra columns are left alone.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import text_of

ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
# Runs are matched greedily to their end, so asking for the least length inside the
# pattern finds the same spans as matching every run and dropping the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
# Least entropy in bits per character of a suspicious window, by character class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
# Candidates that are no secrets: numbers with separators, UUIDs, placeholders.
ALLOW = (r"^[0-9+/_=-]+$",
         r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
         r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6,}")


def candidate_pattern(window: int = WINDOW) -> str:
    """Maximal runs of alphabet characters, ``window`` or longer, that hold a digit."""
    some, letters = "[A-Za-z0-9+/_=-]", "[A-Za-z+/_=-]"
    return f"(?<!{some})(?={letters}*[0-9]){some}{{{window},}}"


def micro_bits(window: int = WINDOW) -> list[int]:
    """``round(1e6 * c * log2 c)`` for c = 0..window."""
    return [0] + [round(1e6 * c * math.log2(c)) for c in range(1, window + 1)]


def largest_sum(bits: float, window: int = WINDOW) -> int:
    """Largest ``sum f(count)`` of a window whose entropy is at least ``bits``."""
    return math.floor(1e6 * window * (math.log2(window) - bits))


def located(text: Column, matches: Column, pattern: str) -> Column:
    """Start, end and value of each of ``matches``, all matches of ``pattern`` in ``text``.

    The pieces between the matches, and so the offsets, come from splitting the
    text at the same pattern; texts without a match are not split.
    """
    empty = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    pieces = F.split(text, pattern, -1)

    def step(state, pair):
        start = state["at"] + F.length(pair["piece"])
        stop = start + F.length(pair["value"])
        found = F.struct(start.alias("start"), stop.alias("stop"), pair["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    pairs = F.transform(matches, lambda m, i: F.struct(m.alias("value"), i.alias("i")))
    zipped = F.zip_with(pairs, F.slice(pieces, 1, F.size(matches)),
                        lambda a, b: F.struct(a["value"].alias("value"), b.alias("piece")))
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    return F.when(F.size(matches) == 0, empty).otherwise(
        F.aggregate(zipped, start, step, lambda s: s["found"]))


def _bump(counts: Column, at: Column, by: int) -> Column:
    """``counts`` with the 1-based entry ``at`` changed by ``by``."""
    return F.concat(F.slice(counts, F.lit(1), at - 1), F.array(F.element_at(counts, at) + by),
                    F.slice(counts, at + 1, F.lit(len(ALPHABET))))


def hot_range(chars: Column, limit: Column, window: int = WINDOW) -> Column:
    """First start and last end (0-based, exclusive) of the windows over ``chars`` whose
    running entropy sum is at most ``limit``; ``stop`` is 0 if there is none."""
    f = F.array(*[F.lit(v).cast("long") for v in micro_bits(window)])
    place = lambda i: F.instr(F.lit(ALPHABET), F.element_at(chars, i))

    def moved(state, at, by):
        now = F.element_at(state["counts"], at)
        change = F.element_at(f, now + 1 + by) - F.element_at(f, now + 1)
        return F.struct(_bump(state["counts"], at, by).alias("counts"),
                        (state["total"] + change).alias("total"),
                        state["first"].alias("first"), state["stop"].alias("stop"))

    def step(state, i):
        # by one transform per update, so that each intermediate state is computed once
        left = F.transform(F.array(state), lambda s: F.when(
            i > window, moved(s, place(i - window), -1)).otherwise(s))
        entered = F.transform(left, lambda s: moved(s, place(i), 1))
        hot = lambda s: (i >= window) & (s["total"] <= limit)
        return F.element_at(F.transform(entered, lambda s: F.struct(
            s["counts"].alias("counts"), s["total"].alias("total"),
            F.when(hot(s) & (s["stop"] == 0), i - window).otherwise(s["first"]).alias("first"),
            F.when(hot(s), i).otherwise(s["stop"]).alias("stop"))), 1)

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
                     F.lit(0).cast("long").alias("total"),
                     F.lit(0).alias("first"), F.lit(0).alias("stop"))
    return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step,
                       lambda s: F.struct(s["first"].alias("first"), s["stop"].alias("stop")))


def entropy_spans(found: Column, window: int = WINDOW, thresholds: dict = THRESHOLDS,
                  allow: tuple = ALLOW) -> Column:
    """Spans of the located candidates ``found`` with a window of high entropy."""
    def limit(value):
        chosen = F.when(value.rlike("^[0-9A-Fa-f]+$"), largest_sum(thresholds["hex"], window))
        chosen = chosen.when(value.rlike("^[0-9A-Za-z]+$"),
                             largest_sum(thresholds["alnum"], window))
        return chosen.otherwise(largest_sum(thresholds["base64"], window)).cast("long")

    suspects = F.filter(found, lambda s: ~s["value"].rlike("|".join(f"(?:{p})" for p in allow)))
    split = F.transform(suspects, lambda s: F.struct(
        s["start"].alias("start"), F.split(s["value"], "").alias("chars"),
        limit(s["value"]).alias("limit")))
    ranged = F.transform(split, lambda s: F.struct(
        s["start"].alias("start"), hot_range(s["chars"], s["limit"], window).alias("hot")))
    return F.transform(F.filter(ranged, lambda s: s["hot"]["stop"] > 0), lambda s: F.struct(
        (s["start"] + s["hot"]["first"]).alias("start"),
        (s["start"] + s["hot"]["stop"]).alias("stop")))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with ``out``: an array of (start, rank, stop, kind), sorted, of all spans.

    ``rank`` is the place of the kind in ``KINDS``. A column of that name is replaced.
    """
    body = text_of(text)
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    row = docs.select(F.struct(*keep).alias("row"), body.alias("body"))
    row = row.select(
        "row", "body",
        F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(0)).alias("m_assign"),
        F.regexp_extract_all("body", F.lit(ACCESS), F.lit(0)).alias("m_access"),
        F.regexp_extract_all("body", F.lit(HEX), F.lit(0)).alias("m_hex"),
        F.regexp_extract_all("body", F.lit(candidate_pattern()), F.lit(0)).alias("m_entropy"))
    row = row.select(
        "row",
        F.filter(located(F.col("body"), F.col("m_assign"), ASSIGN),
                 lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= MIN_VALUE)
        .alias("assign"),
        located(F.col("body"), F.col("m_access"), ACCESS).alias("access"),
        located(F.col("body"), F.col("m_hex"), HEX).alias("hex"),
        located(F.col("body"), F.col("m_entropy"), candidate_pattern()).alias("near"))
    row = row.select("row", "assign", "access", "hex", entropy_spans(F.col("near")).alias("entropy"))

    def tagged(rank, kind):
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"),
            F.lit(kind).alias("kind")))

    spans = F.concat(*[tagged(rank, kind) for rank, kind in enumerate(KINDS)])
    return row.select("row.*", F.array_sort(spans).alias(out))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document the counts per kind, all spans, and a digest of the pattern spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secrets")).alias("spans"))
