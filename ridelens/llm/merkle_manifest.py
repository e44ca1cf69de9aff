"""Merkle manifest of a dataset that stores every third level and recomputes the rest.

A row's leaf is the sha256 of its fields; a language's leaves, ascending by id,
are hashed in runs of eight until one node, its subroot, remains; the subroots,
ordered by language, give the root in the same way. Digests are hexadecimal
text, and a node hashes the concatenation of its run.

Only the leaves and every third level above them are stored, dealt out in
aligned blocks of 8^3 nodes. Building the next stored level hashes three levels
inside a block and forgets the two between. Proofs go from the top down: each
block is read once, the levels between are hashed again from its stored nodes,
the siblings of every node are taken from them, put before the siblings
handed down from the block above, and dropped when the block is done. A proof
is never shuffled: what travels is a row per block, 512 times fewer than leaves.

Places come from a range sort with one count per partition and language, so a
language with most rows is many partitions. Equal rows are told apart by their
stored order, so that copies of one row are no single partition either.

Defined results: a NULL field is written ``-``; a NULL language is a language of
its own, before all others; a NULL id comes first and is never tampered with;
repeated ids are ordered by their leaf, repeated rows each have a leaf and a proof;
a single leaf is its own subroot, a single subroot the root; texts are hashed whole;
other columns are not read; no documents, no rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage
from ridelens.llm.placing import placed

ARITY = 8
KEPT_EVERY = 3
BLOCK = ARITY ** KEPT_EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _field(value: Column) -> Column:
    written = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(written).cast("string"), F.lit(":"), written))


def leaf(*fields: Column) -> Column:
    """Digest of a row: its fields with their byte counts, so that no two rows read alike."""
    return digest(*map(_field, fields))


def _depth(size: Column) -> Column:
    """Levels above ``size`` leaves: the digits of the last leaf's place in base ``ARITY``."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, ARITY))).otherwise(0)


def _raised(nodes: Column) -> Column:
    """The level above an aligned run of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * ARITY + 1, ARITY), "")))


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """One row per aligned block of stored nodes, with the levels between it and its own top."""
    members = F.array_sort(F.collect_list(F.struct("place", "digest", *payload)))
    grouped = nodes.groupBy("tree", "depth", F.floor(F.col("place") / BLOCK).alias("block")).agg(members.alias("nodes"))
    return cut_lineage(grouped)


def _with_levels(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the levels between, hashed again from the stored nodes."""
    found = blocks.withColumn("level0", F.col("nodes.digest"))
    for k in range(1, KEPT_EVERY + 1):
        found = found.withColumn(f"level{k}", _raised(F.col(f"level{k - 1}")))
    return found


@dataclass
class Manifest:
    """The stored levels of one tree per ``tree`` value, from the leaves up, as blocks;
    ``tops`` holds (tree, depth, digest) of each tree's root."""

    levels: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, payload: list[str]) -> Manifest:
    """Trees over ``nodes(tree, place, size, digest, *payload)``; the payload stays with the leaves."""
    nodes = nodes.withColumn("depth", _depth(F.col("size"))).drop("size")
    levels, tops, base = [], None, 0
    while True:
        blocks = _blocks(nodes, payload if base == 0 else [])
        levels.append(blocks)
        left = F.least(F.col("depth") - base, F.lit(KEPT_EVERY))
        top = F.coalesce(*[F.when(left == k, F.col(f"level{k}")[0]) for k in range(KEPT_EVERY + 1)])
        nodes = cut_lineage(_with_levels(blocks).select("tree", "depth", F.col("block").alias("place"), top.alias("digest")))
        base += KEPT_EVERY
        done = nodes.where(F.col("depth") <= base).select("tree", "depth", "digest")
        tops = done if tops is None else tops.union(done)
        nodes = nodes.where(F.col("depth") > base)
        if nodes.isEmpty():
            return Manifest(levels, tops)


def _others(nodes: Column, first: Column, at: Column) -> Column:
    """Siblings of the node at ``at`` in the run of ``nodes`` from ``first`` on (places from 0)."""
    return F.struct(F.array_join(F.slice(nodes, first + 1, at - first), "").alias("left"),
                    F.array_join(F.slice(nodes, at + 2, first + ARITY - 1 - at), "").alias("right"))


def _run_start(at: Column) -> Column:
    return at - at % ARITY


def proofs(manifest: Manifest, above: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, digest, *payload, top, path) of every leaf; ``path`` lists the siblings left and
    right of the way from the leaf to its tree's ``top``, then those of ``above(tree, depth, top, path)``."""
    nodes, none = None, F.array().cast(_PATH)
    for k in reversed(range(len(manifest.levels))):
        base, extra = k * KEPT_EVERY, payload if k == 0 else []
        blocks = manifest.levels[k]
        # trees whose top is over this block start here; the others come from the block above
        starts = F.col("depth") <= base + KEPT_EVERY
        if base:
            starts &= F.col("depth") > base
        upper = above.where(starts).select("tree", F.lit(0).cast("bigint").alias("block"), "top",
                                           F.col("path").alias("upper"))
        if nodes is not None:
            upper = upper.unionByName(nodes.select("tree", F.col("place").alias("block"), "top",
                                                   F.col("path").alias("upper")))
        found = _with_levels(blocks.join(upper, ["tree", "block"]))
        # a block is opened run by run, so that no row carries more than its upper levels
        runs = F.transform(F.sequence(F.lit(0), F.size("level1") - 1),
                           lambda r: F.slice(F.col("nodes"), r * ARITY + 1, ARITY))
        found = found.select("tree", "depth", "top", "upper", *[f"level{i}" for i in range(1, KEPT_EVERY)],
                             F.posexplode(runs).alias("at", "run"))
        way, at = [], F.col("at")
        for i in range(1, KEPT_EVERY):
            way.append(F.when(F.col("depth") > base + i, F.array(_others(F.col(f"level{i}"), _run_start(at), at)))
                       .otherwise(none))
            at = F.floor(at / ARITY).cast("int")
        found = found.select("tree", "depth", "top", "run", F.concat(*way, "upper").alias("rest"))
        found = found.select("tree", "depth", "top", "run", "rest", F.posexplode("run").alias("i", "node"))
        first = F.when(F.col("depth") > base, F.array(_others(F.col("run.digest"), F.lit(0), F.col("i")))).otherwise(none)
        nodes = found.select("tree", "top", "node.place", "node.digest", *[f"node.{c}" for c in extra],
                             F.concat(first, "rest").alias("path"))
    return nodes


def siblings(path: Column) -> Column:
    """The digests of a proof in order, one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def tree_of(lang: Column) -> Column:
    """A language as a key that is never NULL and sorts NULL first, else bytewise."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), lang))


def dataset_manifest(rows: DataFrame, payload: list[str]) -> tuple[Manifest, DataFrame, str | None]:
    """The trees of ``rows(tree, doc_id, digest, *payload)`` by id, (tree, depth, top, path) of
    their subroots on the way to the root, and the root (None without rows)."""
    trees = build(placed(cut_lineage(rows), "doc_id", "digest"), payload)
    names = ["name", "below"]
    subroots = trees.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"),
                                 F.col("depth").alias("below"), "digest")
    top = build(placed(subroots, "name"), names)
    root = top.tops.first()
    nothing = top.tops.select("tree", "depth", F.col("digest").alias("top"), F.array().cast(_PATH).alias("path"))
    ways = proofs(top, nothing, names).select(F.col("name").alias("tree"), F.col("below").alias("depth"),
                                              F.col("digest").alias("top"), "path")
    return trees, cut_lineage(ways), root and root["digest"]


def manifest_report(docs: DataFrame) -> DataFrame:
    """Per row: leaf, subroot, root, digest of its proof, and whether a copy of the row,
    lower-cased where crc32 of the id tells so, still leads to the root."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    touched = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))
    lowered = F.translate(text, _UPPER, _LOWER)
    rows = docs.select(tree_of(lang).alias("tree"), doc_id.alias("doc_id"),
                       leaf(doc_id, source, lang, n_chars, text).alias("digest"),
                       F.when(touched & (lowered != text), leaf(doc_id, source, lang, n_chars, lowered)).alias("found"))
    payload = ["doc_id", "found"]
    trees, ways, root = dataset_manifest(rows, payload)
    proven = proofs(trees, ways, payload)
    root = F.lit(root).cast("string")
    back = folded(F.coalesce("found", "digest"), F.col("path"))
    return proven.select("doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"),
                         F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
                         back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
