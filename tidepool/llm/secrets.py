"""Secret scans with corpus-wide ownership, by DataFrame functions alone.

A kind of candidate takes two regex passes: one for its matches, one for the gaps
between them. A match's place is the sum of the gaps and matches before it, so
the text itself never leaves the scan. Nor do the values: what goes on is a
candidate's SHA-256, its place and whether it looks random.

Hashes are counted corpus-wide by distinct owners and repositories. A value that
over ``max_owners`` owners hold, or over ``max_repos`` repositories of any owner,
is a copied example; one that is rarer and looks random is taken for a live
credential. An owner is the ``owner_col`` of a document, a repository is a
document of it.

Skew: owners of a value are counted from map-side combined distinct (hash,
owner, repository) rows, so a value found in a third of all documents is spread
by owner and repository first.

Defined results: a null text is empty. Rows that repeat doc_id and text are
scanned alike and are one repository. A null owner is an owner of its own.
Places are code points, end exclusive. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut, row_key, text_or_empty

#: The kinds in their order and their patterns.
KINDS = ["assign", "access", "hex", "token", "pem"]
BASE = 3
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "token": r"(?:gh[opsu]|xox[abprs]|[spr]k)[_-][A-Za-z0-9_-]{16,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your|xxxx|\*\*\*|1234567|abcdef"


def _hits(kind: str, text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def _entries(kind: str, hits: Column, text: Column) -> Column:
    """Per match: its kind, number, the gap before it and the match."""
    gaps = F.split(text, PATTERNS[kind], -1)
    rows = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), x["hit"].alias("hit")))
    return F.when(F.size(hits) > 0, F.filter(rows, lambda x: x["hit"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,hit:string>>"))


def looks_live(value: Column) -> Column:
    """At least 8 characters, 6 of them different, a digit and a letter, and no placeholder."""
    return (F.char_length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(value, ""))) >= 6)


def candidates(docs: DataFrame, owner_col: str = "source") -> DataFrame:
    """doc_id, row_key, owner, kind, start, end, value (its SHA-256), random: one row a match, failing ones left out."""
    owner = F.col(owner_col).cast("string") if owner_col in docs.columns else F.lit(None).cast("string")
    text = text_or_empty()
    found = docs.select("doc_id", "text", owner.alias("owner")).select("doc_id", "owner", text.alias("text"), row_key().alias("row_key"), *[_hits(k, text).alias(f"hits_{k}") for k in KINDS])
    rows = found.select("doc_id", "row_key", "owner", F.explode(F.concat(*[_entries(k, F.col(f"hits_{k}"), F.col("text")) for k in KINDS])).alias("x")).select("doc_id", "row_key", "owner", "x.*")
    rows = rows.withColumn("value", F.when(F.col("kind") == 0, F.regexp_extract("hit", PATTERNS["assign"], 2)).otherwise(F.col("hit")))
    random = looks_live(F.col("value")) | (F.col("kind") == KINDS.index("pem"))
    fails = (F.col("kind") == 0) & (F.char_length("value") < 6)
    # from here on a value is its hash
    rows = rows.select("doc_id", "row_key", "owner", "kind", "i", "gap", F.char_length("hit").alias("size"), fails.alias("fails"), random.alias("random"), F.sha2("value", 256).alias("value"))
    rows = cut(rows.dropDuplicates())
    before = Window.partitionBy("doc_id", "row_key", "owner", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("long")).withColumn("start", F.col("end") - F.col("size"))
    return placed.where(~F.col("fails")).select("doc_id", "row_key", "owner", "kind", "start", "end", "value", "random")


def ownership(found: DataFrame) -> DataFrame:
    """value (its hash), n_owners, n_repos: in how many sources and documents a value stands."""
    each = found.groupBy("value", F.coalesce("owner", F.lit("")).alias("owner"), "doc_id", "row_key").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def scan_secrets(docs: DataFrame, owner_col: str = "source", max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """doc_id, row_key, owner, kind, start, end, value (its SHA-256), random, n_owners, n_repos, live: one row a span."""
    found = candidates(docs, owner_col)
    joined = found.join(ownership(found), "value")
    return joined.withColumn("live", F.col("random") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def secrets_by_document(docs: DataFrame, owner_col: str = "source", max_owners: int = 2, max_repos: int = 20) -> DataFrame:
    """One row a document: counts and digests of the base kinds, all spans, and how many are live or shared.

    Spans beyond the base kinds are listed where they are live.
    """
    spans = scan_secrets(docs, owner_col, max_owners, max_repos).where((F.col("kind") < BASE) | F.col("live"))
    spans = spans.drop("owner").dropDuplicates(["doc_id", "row_key", "kind", "start"])
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    item = F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("span"))
    is_base = F.col("kind") < BASE
    per = spans.groupBy("doc_id", "row_key").agg(
        *[F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])],
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_shared"),
        F.array_sort(F.collect_list(F.when(is_base, item))).alias("base"),
        F.array_sort(F.collect_list(item)).alias("every"),
    )
    per = per.select("doc_id", "row_key", "n_assign", "n_access", "n_hex", "n_live", "n_shared", F.array_join("base.span", ",").alias("base"), F.array_join("every.span", ",").alias("every"))
    ids = docs.select(F.col("doc_id").alias("id"), row_key().alias("key"))
    out = ids.join(per, ids["id"].eqNullSafe(per["doc_id"]) & (ids["key"] == per["row_key"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("id").alias("doc_id"), *[zero(c) for c in ("n_assign", "n_access", "n_hex", "n_live", "n_shared")], F.sha2(F.encode(F.coalesce("base", F.lit("")), "UTF-8"), 256).alias("base_sha256"), F.coalesce("every", F.lit("")).alias("spans"))
