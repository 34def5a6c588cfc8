"""Document sources and stores."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.checkpoint import dropping_shuffles, settings
from tidepool.functions.text import extension

Loader = Callable[[SparkSession, list[str]], DataFrame]
LOADERS: dict[str, Loader] = {}


def register_loader(ext: str, load: Loader) -> None:
    """``load(spark, paths)`` returns source, page (null if the format has none), text; one for folders below takes reader options too."""
    LOADERS[ext] = load


def load_text(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """A row a file."""
    return spark.read.options(**options).text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.lit(None).cast("int").alias("page"), F.col("value").alias("text"))


def load_pdf(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """A row a page; needs the pypdf library on the executors."""

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for b in batches:
            rows = [(s, i, p.extract_text()) for s, c in zip(b["path"], b["content"], strict=True) for i, p in enumerate(PdfReader(io.BytesIO(c)).pages)]
            yield pd.DataFrame(rows, columns=["source", "page", "text"])

    return spark.read.format("binaryFile").options(**options).load(paths).select("path", "content").mapInPandas(pages, "source string, page int, text string")


register_loader("txt", load_text)
register_loader("pdf", load_pdf)


#: Small files share tasks by their bytes; with Spark's own 4 MB for each file's opening a task has 32 of them.
OPEN_COST = {"spark.sql.files.openCostInBytes": str(128 << 10)}
#: Tasks that list folders; Spark's own 10,000 are a folder each.
LISTING = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64"}


def list_files(spark: SparkSession, folder: str, below: bool = False) -> DataFrame:
    """path, ext of the files right in the folder, or with ``below`` at any depth; reads no contents.

    With ``below`` many folders are listed by tasks; a pattern of folders would be by the driver.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(below).lower())
    return reader.load(folder if below else f"{folder}/*").select("path").withColumn("ext", extension(F.col("path")))


def load_folder(spark: SparkSession, folder: str, on_unknown: str = "error", below: bool = False) -> DataFrame:
    """Pages of all files of the folder, with ``below`` at any depth. A file of another kind is an error, or left out with on_unknown="skip"."""
    with settings(spark, OPEN_COST | LISTING):
        found = [r["ext"] for r in list_files(spark, folder, below).select("ext").distinct().collect()]
    unknown = sorted(set(found) - set(LOADERS))
    if unknown and on_unknown != "skip":
        raise ValueError(f"Extension {unknown[0]} not supported")
    of = lambda e: ([folder], {"recursiveFileLookup": "true", "pathGlobFilter": f"*.{e}"}) if below else ([f"{folder}/*.{e}"], {})
    with settings(spark, LISTING):
        parts = [LOADERS[e](spark, of(e)[0], **of(e)[1]) for e in found if e in LOADERS]
    if not parts:
        return spark.createDataFrame([], "source string, page int, text string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_store(chunks: DataFrame, path: str) -> None:
    """Replaces the store, so a second ingestion leaves no second copy."""
    with dropping_shuffles(chunks.sparkSession):
        chunks.select("*").write.mode("overwrite").parquet(path)


def overwrite_parts(rows: DataFrame, path: str, column: str, parts: list[int]) -> None:
    """Replaces these parts of a store by rows, which hold no others; a part without rows goes, the other parts stay as they are.

    The rows may be read from the parts they replace: these give way only once all is
    written beside them. Rows should lie by part, as each task writes a file for each part it has.
    """
    spark = rows.sparkSession
    seen = Observation()
    marked = rows.select("*").observe(seen, F.collect_set(column).alias("full"))
    with dropping_shuffles(spark):
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)
    full = set(seen.get["full"])
    for p in parts:
        if p not in full:
            remove(spark, f"{path}/{column}={p}")


def read_store(spark: SparkSession, path: str, schema: StructType | None = None, on_error: str = "raise") -> DataFrame:
    """The store's chunks. With on_error="empty" files that are missing or broken hold no rows, and a store that isn't there none at all."""
    if on_error == "raise":
        return spark.read.parquet(path)
    if on_error != "empty" or schema is None:
        raise ValueError("on_error is raise, or empty with a schema")
    try:
        return spark.read.schema(schema).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        logging.getLogger(__name__).error("no store at %s", path)
        return spark.createDataFrame([], schema)


#: Folders that ``write_texts`` deals files out to, at least: so many are listed by tasks, not by the driver.
FOLDERS = 64


def write_texts(rows: DataFrame, folder: str) -> None:
    """rows: name, value. A text file of each name, in folders below; values of one name are lines of one file.

    Where the folder is of a mounted file system tasks write the files themselves: Hadoop's writer starts
    processes for the rights of each file there. Elsewhere it is Spark's writer, with a folder a name.
    """
    sc = rows.sparkSession.sparkContext
    dealt = rows.select("name", "value").repartition(max(FOLDERS, 4 * sc.defaultParallelism), "name")
    if re.match("[A-Za-z][A-Za-z0-9+.-]+:", folder) and not folder.startswith("file:"):
        # tasks put their files in place themselves; by version 1 the driver would move each one again
        with dropping_shuffles(rows.sparkSession):
            dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(folder)
        return
    top = re.sub("^file:/*", "/", folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        own = f"{top}/{task.partitionId()}"
        os.makedirs(own, exist_ok=True)
        lines = ((n, v) for b in batches for n, v in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True))
        n = 0
        for name, values in groupby(lines, key=lambda x: x[0]):
            # an attempt that is given up leaves no half a file under the name
            part = f"{own}/.{task.taskAttemptId()}"
            with open(part, "wb") as f:
                for _, v in values:
                    f.write(v + b"\n")
            os.replace(part, f"{own}/{name}.txt")
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    with dropping_shuffles(rows.sparkSession):
        dealt.sortWithinPartitions("name").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def file_names(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_name").distinct()
