"""The corpus pipeline: five stages from raw documents to a training order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``; the last returns one row per reading of a document,
with ``epoch``, ``words`` and ``position`` added, range-sorted by position. Empty
tables, NULLs and repeated rows are handled as each operator states.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.curriculum_mix import training_order
from ridelens.llm.line_chunks import remove_repeats
from ridelens.llm.qgram_decontam import drop_leaking
from ridelens.llm.simhash_gray import MAX_BITS, SHINGLE_WORDS, keep_first
from ridelens.llm.toxic_ssk import drop_toxic
from ridelens.session import new_scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the string-kernel model does not call toxic; it learns from the labelled
    documents among ``docs``."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line chunks that stand in an earlier place;
    ``n_chars`` follows the text."""
    cut = remove_repeats(docs, counts=())
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints: the least id."""
    return keep_first(docs, SHINGLE_WORDS, MAX_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return drop_leaking(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: readings of documents by position on the curriculum."""
    return training_order(docs).drop("size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

# The stages train models and align texts: SQL cannot express them. tests/llm compares
# every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what the stages before it keep is written in the shared
    scratch folder, so that no stage is computed twice or lost with an executor."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_scratch_path(spark, "pipeline-" + name.lower().replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
