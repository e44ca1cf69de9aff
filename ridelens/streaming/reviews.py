"""Incremental review classification: new review files in, labelled rows out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ridelens.operators.keywords import DEFAULT_DICTIONARY, Dictionary, classify_reviews


def classify_review_files(spark: SparkSession, source_dir: str, schema: StructType | str,
                          sink_dir: str, checkpoint: str, source_format: str = "parquet",
                          text_col: str = "review",
                          dictionary: Dictionary = DEFAULT_DICTIONARY,
                          available_now: bool = True,
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Label every review file that lands in ``source_dir`` and append the
    result (the classified-review columns) as Parquet to ``sink_dir``.

    ``checkpoint`` is the folder, on shared storage, that belongs to this source
    and sink: a restart with the same folder resumes after the last file it has
    labelled (a fresh folder for a used sink would lose batches, so there is no
    default). ``available_now`` processes what is there in bounded batches and stops
    (scheduled incremental runs); otherwise the query keeps running.
    """
    reader = spark.readStream.schema(schema).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    labelled = classify_reviews(reader.load(source_dir), text_col, dictionary)
    writer = (labelled.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
