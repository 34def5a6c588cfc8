"""Near-dedup of the pipeline: SimHash's components, joined with those of exact Jaccard similarity.

SimHash (``simhash``: three words, three bits) finds the classes; texts alike in at least
four of five five-word shingles that lie further apart in bits are linked by ``shingles``.
A document is reachable over links of either kind, so neither loses one of the other's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import shingles, simhash
from tidepool.llm.common import cut


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: its smallest doc_id. Of rows that repeat that doc_id, one stays."""
    # both roots hang on the text alone, so a text's key brings them together
    bits = cut(simhash.near_duplicates(docs).select("row_key", F.col("root").alias("class")).dropDuplicates())
    near = cut(shingles.near_duplicates(docs).select("doc_id", "row_key", "root"))
    met = near.select("row_key", "root").dropDuplicates().join(bits, "row_key").select("class", "root").dropDuplicates()
    heads = met.groupBy("class").agg(F.min("root").alias("v"), F.max("root").alias("last")).where("v <> last").select("class", "v")
    links = met.join(heads, "class").where("root <> v").select(F.col("root").alias("u"), "v")
    joined = simhash.components(links).select(F.col("node").alias("root"), F.col("root").alias("to"))
    placed = near.join(joined, "root", "left").withColumn("component", F.coalesce("to", "root"))
    first = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("x"))
    return simhash.keep_rows(docs, first.select("x.doc_id", "x.row_key"))
