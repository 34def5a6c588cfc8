"""Ingestion of files as they arrive: a file is chunked whole within its micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidepool.config import Config
from tidepool.plans.ingest import chunk
from tidepool.providers import get_embedding


def arriving(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def watch_text_folder(spark: SparkSession, folder: str, store: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Appends both stores' chunks of each new text file; a batch that is retried overwrites its own part."""
    c = config or Config()
    embed = get_embedding(c.embedding_name)
    pages = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        for name, rows in zip(("small", "medium"), chunk(batch, c), strict=True):
            rows.withColumn("embedding", embed(F.col("embed_text"))).write.mode("overwrite").parquet(f"{store}/chunks_{name}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
