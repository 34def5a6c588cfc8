"""Lengths in byte-pair tokens, and chunks cut by them, where the texts lie.

Words are what the vocabulary's pattern splits a text into, on the JVM. Some hundred rows
at a time their distinct words are merged by the vocabulary's ranks, so nothing but sums by
key is shuffled. A worker remembers the lengths of words that make up ``HOT_SHARE`` of such
a batch, counted for every 64 bytes they have, so that long ones of a single place aren't
held, and starts anew beyond ``KNOWN_WORDS``; its memory is bounded, whatever the table.

Defined results: a null or empty text has no tokens. Rows of equal keys count together.
Strings of special tokens are ordinary text. Letters that Java's Unicode tables don't know
yet count as signs. Texts of any length are counted whole; empty tables give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

HOT_SHARE = 1e-5
#: Words that a worker remembers before it starts anew, and rows whose words are looked up at once.
KNOWN_WORDS, BATCH_ROWS = 500_000, 128
#: Fixed value: the split of byte-level vocabularies into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, and the pattern that cuts texts into words."""

    ranks: Mapping[bytes, int]
    pattern: str = WORDS

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit("(?U)" + self.pattern), F.lit(0))


def read_vocabulary(path: str, pattern: str = WORDS) -> Vocabulary:
    """From a file with a base64 string and its rank on each line."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def merged_length(word: bytes, ranks: Mapping[bytes, int]) -> int:
    """How many tokens are left of a word when the neighbours of least rank are merged, leftmost first, while any can be.

    Candidates wait in a heap, so a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return 1
    n = len(word)
    stop = list(range(1, n + 1))  # where the part that begins here ends; 0 if none does
    before = list(range(-1, n - 1))  # where the part before this one begins
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        middle = stop[start]
        if middle < n:
            rank = ranks.get(word[start : stop[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, start, stop[middle]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, start, end = heapq.heappop(heap)
        middle = stop[start]
        if not middle or middle >= n or stop[middle] != end:
            continue  # one of the two has been merged since
        stop[start], stop[middle] = end, 0
        if end < n:
            before[end] = start
            offer(start)
        if before[start] >= 0:
            offer(before[start])
    return sum(map(bool, stop))


class _Known(dict):
    """Lengths of words by the vocabulary of one digest."""

    def __init__(self, digest: str):
        super().__init__()
        self.digest = digest

    def of(self, words: pa.Array, ranks: Mapping[bytes, int], share: float) -> np.ndarray:
        """The length of each word; each distinct one is looked up or merged once."""
        if len(self) > KNOWN_WORDS:
            self.clear()
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        distinct = coded.dictionary.to_pylist()
        n = np.fromiter(map(self.get, distinct, itertools.repeat(0)), np.int64, len(distinct))
        counts = np.bincount(code, minlength=len(distinct))
        for i in np.flatnonzero(n == 0).tolist():
            word = distinct[i].encode()
            n[i] = merged_length(word, ranks)
            if counts[i] >= share * len(code) * -(-len(word) // 64):
                self[distinct[i]] = int(n[i])
        return n[code]


_KNOWN = _Known("")


def _known(digest: str) -> _Known:
    """One memory a worker process, which serves the tasks that it runs in turn."""
    global _KNOWN
    if _KNOWN.digest != digest:
        _KNOWN = _Known(digest)
    return _KNOWN


def _by_batch(rows: DataFrame, schema: str | StructType, vocabulary: Vocabulary, compute: Callable[[list[pa.Array], pa.Array, np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """compute(other columns, all words of some rows, their lengths, where each row's begin and the last ends), for rows whose last column has the words."""
    ranks = rows.sparkSession.sparkContext.broadcast(dict(vocabulary.ranks))
    digest, share = hashlib.md5(repr(sorted(vocabulary.ranks.items())).encode()).hexdigest(), HOT_SHARE
    names = [f.name for f in (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                *others, column = batch.slice(at, BATCH_ROWS).columns
                words = column.flatten()
                bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(compute(others, words, _known(digest).of(words, ranks.value, share), bounds), names=names)

    return rows.mapInArrow(run, schema)


def token_lengths(rows: DataFrame, key: Sequence[str], vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """key, n_tokens: the length of each key's texts."""
    own = rows.select(*key, vocabulary.words(F.col(text)).alias("words"))
    schema = StructType([*own.drop("words").schema.fields, StructField("n_tokens", LongType())])

    def sums(keys: list[pa.Array], words: pa.Array, lengths: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        return [*keys, pa.array(np.diff(np.append(0, np.cumsum(lengths))[bounds]))]

    return _by_batch(own, schema, vocabulary, sums).groupBy(*key).agg(F.sum("n_tokens").alias("n_tokens"))


def fill(lengths: np.ndarray, size: int) -> list[int]:
    """Where chunks begin and the last ends: each takes words while they are at most ``size`` tokens, and at least one word."""
    ends = np.cumsum(lengths)
    cuts = [0]
    while cuts[-1] < len(lengths):
        done = ends[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, done + size, "right"))))
    return cuts


def split_by_tokens(pages: DataFrame, vocabulary: Vocabulary, size: int = 100) -> DataFrame:
    """source, small_chunk_idx, n_chunks, n_tokens, raw_text: runs of whole words of at most ``size`` tokens.

    A word that is longer stands alone. A source's chunks put together are its text;
    rows of one source are cut each on their own, so their numbers repeat. Nothing is shuffled.
    """
    own = pages.where("text <> ''").select("source", vocabulary.words(F.col("text")).alias("words"))

    def chunks(others: list[pa.Array], words: pa.Array, lengths: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        cuts = [a + np.array(fill(lengths[a:z], size)) for a, z in itertools.pairwise(bounds.tolist())]
        n = np.array([len(c) - 1 for c in cuts])
        starts, ends = (np.concatenate([np.empty(0, np.int64), *[c[of] for c in cuts]]) for of in (slice(-1), slice(1, None)))
        row = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        total = np.append(0, np.cumsum(lengths))
        # a row's words put together are its text, and so lie side by side: a chunk is what is between two of them
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:] if len(ends) else 0).astype(np.int32)), words), "")
        return [others[0].take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(n[row].astype(np.int32)), pa.array(total[ends] - total[starts]), texts]

    return _by_batch(own, "source string, small_chunk_idx int, n_chunks int, n_tokens long, raw_text string", vocabulary, chunks)
