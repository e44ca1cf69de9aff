"""Small helpers shared by the text operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.session import scratch_dir

# A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder.

    The copy survives lost executors and is removed by Spark's cleaner when it
    is no longer referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def text_of(name: str = "text") -> Column:
    """The text column with NULL read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a NULL id counts as '')."""
    written = F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.crc32(written.cast("binary")) % modulus


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
