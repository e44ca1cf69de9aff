"""Line dedup by content-defined chunks of lines.

A text is its lines, parted by ``\\n``. Each line has a 32-bit hash; a rolling
hash runs over the hashes of the last ``WINDOW`` lines, and a chunk ends after
every line where it is divisible by ``DIVISOR`` (and at the end of the text). A
boundary depends on a few lines only, so inserting or removing lines moves none
but the nearby ones, and a repeated run of lines falls into the same chunks
wherever it stands. Of the chunks of two or more lines that occur more than
once in the corpus, the first occurrence (by id, then text, then place) stays
and the others are removed.

Chunks meet by a 64-bit hash and their length; the bytes decide: chunks are counted
by the SHA-256 of their texts, and where two different texts share a hash the chunks
are told apart by their texts. Occurrences are counted map-side, so a chunk with a
third of all occurrences is a few rows per task; the texts themselves are shuffled
once, to be rebuilt.

Defined results: NULL and empty texts have no chunk to remove and stay as they
are; chunks of one line always stay (so one repeated line never goes); a text
may lose all its lines and become empty; rows with equal id and text are one
document and get equal results; a NULL id is ordered last; other columns are
carried along untouched; no documents, no rows. Lines and texts may be of any
length.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import cut_lineage, text_of

WINDOW = 3
BASE = 257
DIVISOR = 4
MIN_LINES = 2


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks_of(text: Column) -> Column:
    """The text's chunks in order: array of (n_lines, body)."""
    def ends(hashes):
        def ends_chunk(i):
            rolled = F.element_at(hashes, i)
            for back in range(1, WINDOW):
                rolled = rolled + BASE ** back * F.coalesce(F.try_element_at(
                    hashes, F.when(i > back, i - back).otherwise(F.size(hashes) + 1)), F.lit(0))
            return (rolled % DIVISOR == 0) | (i == F.size(hashes))
        return F.filter(F.sequence(F.lit(1), F.size(hashes)), ends_chunk)

    def cut(lines):
        def between(stops):
            def piece(stop, k):
                start = F.when(k == 0, 0).otherwise(F.try_element_at(stops, F.greatest(k, F.lit(1))))
                return F.struct((stop - start).alias("n_lines"), F.array_join(
                    F.slice(lines, start + 1, stop - start), "\n").alias("body"))
            return F.transform(stops, piece)
        return _bound(_bound(F.transform(lines, line_hash), ends), between)

    return _bound(F.split(text, "\n", -1), cut)


def _occurrences(docs: DataFrame, chunk_hash) -> DataFrame:
    """Chunks of ``MIN_LINES`` or more lines: document key, place, size, hash and body."""
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("by_text"),
                        F.posexplode(chunks_of(text_of())).alias("place", "chunk"))
    keyed = keyed.where(F.col("chunk.n_lines") >= MIN_LINES)
    body = F.col("chunk.body")
    return keyed.select("doc_id", "by_text", "place", F.col("chunk.n_lines").alias("n_lines"),
                        F.length(body).alias("size"), chunk_hash(body).alias("hash"),
                        body.alias("body"))


def repeats(docs: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """(doc_id, by_text, places, lines): the chunks to remove, per document that has any."""
    found = _occurrences(docs, chunk_hash)
    small = cut_lineage(found.drop("body"))
    digest = F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")
    counted = found.groupBy("hash", "size", digest).agg(F.count(F.lit(1)).alias("n"))
    shared = cut_lineage(counted.groupBy("hash", "size").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where("n > 1"))
    told = small.join(shared.where("texts = 1").select("hash", "size"), ["hash", "size"], "left_semi") \
        .withColumn("body", F.lit(""))
    clashing = shared.where("texts > 1").select("hash", "size")
    if not clashing.isEmpty():
        told = told.unionByName(found.join(clashing, ["hash", "size"], "left_semi"))
    key = ["hash", "size", "body"]
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "by_text", "place")
    first = told.groupBy(key).agg(F.min(order).alias("first"))
    later = told.join(first, key).where(order != F.col("first"))
    gone = later.groupBy("doc_id", "by_text").agg(
        F.collect_set(F.struct("place", "n_lines")).alias("gone"))
    return gone.select("doc_id", "by_text", F.col("gone.place").alias("places"),
                       F.aggregate("gone.n_lines", F.lit(0), lambda a, n: a + n).alias("lines"))


COUNTS = ("removed_chunks", "removed_lines")


def remove_repeats(docs: DataFrame, chunk_hash=F.xxhash64, counts: tuple = COUNTS) -> DataFrame:
    """``docs`` with the repeated chunks cut out of ``text``, and the numbers of removed
    chunks and lines in the columns ``counts`` (replacing any of that name), if given."""
    gone = repeats(docs, chunk_hash).select(
        F.col("doc_id").alias("gone_id"), F.col("by_text").alias("gone_text"), "places", "lines")
    names = [c for c in docs.columns if c.lower() not in counts]
    rows = docs.select(F.struct(*names).alias("row"))
    both = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id"))
                     & (F.xxhash64(text_of("row.text")) == F.col("gone_text")), "left")
    pieces = chunks_of(text_of("row.text"))
    kept = _bound(pieces, lambda p: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("places")),
        lambda k: F.element_at(p, k + 1)["body"]), "\n"))
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept)
    numbers = [F.coalesce(F.size("places"), F.lit(0)).cast("long"), F.coalesce("lines", F.lit(0)).cast("long")]
    result = F.struct(*[(text if c.lower() == "text" else F.col("row")[c]).alias(c) for c in names],
                      *[number.alias(name) for number, name in zip(numbers, counts)])
    # Through a generator, so that what is built on the text (a Python UDF, say) takes it
    # as a column and not as the whole expression.
    return both.select(F.inline(F.array(result)))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document the lines and chunks removed, and a digest of the text that stays."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "removed_chunks", "removed_lines",
        F.md5(text_of().cast("binary")).alias("text_md5"))
