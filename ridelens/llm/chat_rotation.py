"""Chat formatting by perspective rotation.

A dialogue of several speakers becomes one training text per participant: that
speaker's turns are the assistant's, the others are users named after
themselves, and the mask holds the character spans the model is trained on -
the assistant's words and the mark that ends them.

Turns are ordered by turn number, then speaker, then text. Speakers in
``SYSTEM_ROLES`` give context: their turns are rendered as system turns and they
have no perspective of their own. Marks that occur inside a text or a name are
escaped, so that a rendered text parses back into its turns.

A dialogue is cut into parts of ``PART_TURNS`` turn numbers, each rendered as a
text of its own for every participant of the whole dialogue: no task and no row
holds more than a part, however long the dialogue. Equal rows of a part travel
once with their number.

Defined results: a NULL speaker is rendered as the user ``unknown`` and has no
perspective; a NULL text is an empty turn; a NULL turn number stands last, in a
part of its own; NULL ids make one dialogue; a dialogue without participants
(system turns only) gives no row; repeated rows are repeated turns; an empty text
of the assistant still trains its end mark; no turns, no rows. Other columns are
not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM_ROLES = ("system",)
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"
UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    """Text in which no mark can begin: ``<|`` is written ``<\\|`` (and ``<\\`` ``<\\\\``)."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def head(speaker: Column, perspective: Column, system_roles=SYSTEM_ROLES) -> Column:
    """The mark that opens a turn, as seen from ``perspective``."""
    name = F.replace(escaped(F.coalesce(speaker, F.lit(UNKNOWN))), F.lit("|>"), F.lit("|\\>"))
    return F.when(speaker.isin(*system_roles), f"{OPEN}system{CLOSE}") \
        .when(speaker == perspective, f"{OPEN}assistant{CLOSE}") \
        .otherwise(F.concat(F.lit(f"{OPEN}user "), name, F.lit(CLOSE)))


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role",
           text: str = "text", system_roles=SYSTEM_ROLES, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, perspective, n_turns, n_trained, rendered, mask): one row per part of a
    dialogue and participant; mask is an array of (start, stop) in code points."""
    rows = turns.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.col(speaker).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    part = F.floor(F.col("turn") / part_turns).cast("long")
    counted = rows.groupBy("conv_id", part.alias("part"), "turn", "speaker", "text").agg(
        F.count(F.lit(1)).cast("int").alias("times"))
    order = F.struct(F.col("turn"), F.col("speaker").isNull().alias("unnamed"), "speaker", "text", "times")
    parts = counted.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    parts = parts.select("conv_id", "part", F.flatten(F.transform(
        "turns", lambda t: F.array_repeat(t, t["times"]))).alias("turns"))
    people = rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system_roles)) \
        .select(F.col("conv_id").alias("its_id"), F.col("speaker").alias("perspective")).distinct()
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("its_id")))

    trained = lambda t: F.coalesce(t["speaker"] == F.col("perspective"), F.lit(False))
    pieces = F.transform("turns", lambda t: F.struct(
        head(t["speaker"], F.col("perspective"), system_roles).alias("head"),
        F.concat(escaped(t["text"]), F.lit(END)).alias("body"), trained(t).alias("trained")))

    def step(state, p):
        start = state["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.struct(start.alias("start"), stop.alias("stop"))
        return F.struct(stop.alias("at"), F.when(p["trained"], F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast("array<struct<start:int,stop:int>>")
    seen = seen.select("conv_id", "part", "perspective", pieces.alias("pieces"))
    return seen.select(
        "conv_id", "part", "perspective", F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["trained"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        F.aggregate("pieces", F.struct(F.lit(0).alias("at"), empty.alias("spans")), step,
                    lambda s: s["spans"]).alias("mask"))


def rotation_report(turns: DataFrame) -> DataFrame:
    """``rotate`` with the mask written as ``start:stop``, comma-joined."""
    return rotate(turns).withColumn("mask", F.array_join(F.transform(
        "mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ","))
