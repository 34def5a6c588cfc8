"""Toxicity by weak supervision.

Many voters look at each labelled row of a bounded sample; each votes toxic or
clean, or abstains. Lexicon voters hold a share of a fixed list of insults, or of
words that lean to toxic rows; pattern voters hold word beginnings of 4 to 6
letters, or look at how much of a text such terms make up. A voter with no hit
abstains on texts that are too short to judge.

A generative model of two classes estimates, by expectation maximisation that
starts at the share of toxic votes, how often each voter votes which way in
either class and how voters correlate within a class; correlated voters share
their weight. Gold labels find the terms of the mined voters and nothing else:
the model never sees them, and the linear classifier over terms is trained on
the model's posteriors alone. The classifier then scores every whole text.

What is collected is bounded by ``sample_rows`` and ``max_terms``, both
parameters; the model that is broadcast has at most ``max_terms`` weights and
those of the fixed list. With ``copies_once`` sampled rows of one label that
agree in four min-hashes of three-word shingles count once, so that a text's
words don't count as often as it was copied.

Defined results: labels are learnt only from rows whose crc32(doc_id as text)
mod 3 is not 1, and language, source and doc_id are never inputs of a score. A
null text is empty; an empty text gets the classifier's constant. Without both
classes among the labels every score is the share of toxic ones, or 0. Rows that
repeat are scored alike. Null labels and extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut, unused

SAMPLE_ROWS = 20_000
MAX_TERMS = 4_000
#: Entries of a task's counts before they are sent on.
COUNTER_ENTRIES = 400_000
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")
#: Words of a text from which on a voter without a hit votes clean.
ENOUGH_WORDS = 12
#: Common English insults, for voters that no label has a part in.
INSULTS = (
    "airhead arrogant bastard bigot bonehead brainless brat buffoon bully clown coward creep cretin crook deadbeat degenerate "
    "delusional disgrace disgusting dope dork dumb dumbass dunce failure fool freak fraud garbage gross halfwit hideous "
    "hypocrite idiot idiotic ignorant imbecile incompetent jackass jerk lame liar loser lowlife lunatic maniac miserable "
    "moron moronic nasty nitwit nobody nutcase pathetic pest pig psycho punk rat repulsive retarded ridiculous rotten rubbish "
    "scum scumbag shameful shameless sicko sleazy slob snake stupid sucker swine thug trash trashy twisted ugly useless "
    "vermin vile weasel weirdo wimp worthless wretch"
).split()


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def terms_of(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words with a trailing *."""
    words = set(_WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Model:
    """A linear classifier over known terms."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def known(self, text: str) -> list[str]:
        words = set(_WORD.findall(text.lower()))
        found = words & self.weights.keys()
        by_length = self._beginnings()
        for n, starts in by_length.items():
            found |= {f"{b}*" for b in {w[:n] for w in words if len(w) > n} & starts}
        return sorted(found)

    def words_known(self, text: str) -> tuple[int, float]:
        """How many different words of the text hold a known term, and the sum of their strongest ones."""
        sums = []
        for w in set(_WORD.findall(text.lower())):
            own = [self.weights[t] for t in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n)) if t in self.weights]
            if own:
                sums.append(max(own))
        return len(sums), float(sum(sums))

    def _beginnings(self) -> dict[int, set[str]]:
        if "_starts" not in self.__dict__:
            self._starts: dict[int, set[str]] = {n: {t[:-1] for t in self.weights if t.endswith("*") and len(t) == n + 1} for n in PREFIXES}
        return self._starts

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[t] for t in self.known(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


TOXIC, CLEAN, SILENT = 1, 0, -1


def label_model(votes: np.ndarray, rounds: int = 50, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, rates, weights) of a two-class model of rows x voters TOXIC, CLEAN or SILENT votes.

    A rate, by class and voter, is how often the votes it casts on that class are
    toxic; a silent voter tells nothing. A voter's weight is 1 over one plus its
    positive correlations with other voters within the classes, so a block of
    copies counts about once. Class 1 is the one in which the estimation starts:
    the share of toxic votes, or ``start`` where a caller trusts some voters more.
    """
    cast, toxic = (votes != SILENT).astype(float), (votes == TOXIC).astype(float)
    p = np.clip(toxic.sum(1) / np.maximum(1, cast.sum(1)), 0.02, 0.98)
    p = np.clip(p / max(p.max(initial=0), 1e-9), 0.02, 0.98)  # the row with the largest share is sure of its class
    p = p if start is None else np.clip(start, 0.02, 0.98)
    for _ in range(rounds):
        both = np.stack([1 - p, p])
        rate = np.clip((both @ toxic + 0.5) / (both @ cast + 1.0), 1e-3, 1 - 1e-3)
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        residual = (toxic - both.T @ rate) * cast
        scale = np.sqrt((residual**2).sum(0)) + 1e-9
        corr = np.clip((residual.T @ residual) / scale[:, None] / scale[None, :], 0, 1)
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + corr.sum(1))
        ratio = toxic @ (weight * np.log(rate[1] / rate[0])) + (cast - toxic) @ (weight * np.log((1 - rate[1]) / (1 - rate[0])))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ratio, -30, 30)))
        moved = np.abs(new - p).max(initial=0)
        p = new
        if moved < 1e-4:
            break
    return p, rate, weight


def logistic(rows: np.ndarray, cols: np.ndarray, n_cols: int, target: np.ndarray, ridge: float = 0.05, steps: int = 800) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on soft targets over sparse 0/1 entries, by accelerated gradient steps."""
    n = len(target)
    w, bias = np.zeros(n_cols), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    product = lambda x, b: b + np.bincount(rows, weights=x[cols], minlength=n)
    back = lambda g: np.bincount(cols, weights=g[rows], minlength=n_cols)
    x, top = np.ones(n_cols), 1.0  # the largest curvature, by power iteration
    for _ in range(20):
        x = back(product(x, 0.0))
        top = float(np.linalg.norm(x))
        x /= top or 1.0
    step = 1 / (0.25 * (top + n) + ridge)
    ahead, ahead_bias = w.copy(), bias
    for k in range(steps):
        g = 1 / (1 + np.exp(-np.clip(product(ahead, ahead_bias), -30, 30))) - target
        new, new_bias = ahead - step * (back(g) + ridge * ahead), ahead_bias - step * float(g.sum())
        ahead, ahead_bias = new + k / (k + 3) * (new - w), new_bias + k / (k + 3) * (new_bias - bias)
        w, bias = new, new_bias
    return bias, w


_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _signature(text: str) -> int:
    """Four min-hashes of three words in a row, as one hash: near copies mostly share it, texts with a common passage do not."""
    words = _WORD.findall(text.lower())
    own = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint64)
    mixed = (own + np.uint64(1)) * _SEEDS[:, None]
    return zlib.crc32((mixed ^ (mixed >> np.uint64(31))).min(1).tobytes()) if words else 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signatures = pa.array([_signature(t or "") for t in batch.column(2).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, signatures], names=[*batch.schema.names, "signature"])


def _sample(docs: DataFrame, labels: DataFrame, rows: int, copies_once: bool) -> DataFrame:
    """label, text of at most ``rows`` labelled rows that may be learnt from, chosen by a hash of their id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    if not copies_once:
        return cut(found.select("label", "text"))
    signed = found.mapInArrow(_sign, "doc_id long, label int, text string, signature long")
    one = signed.groupBy("signature", "label").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    return cut(one.select("label", "x.text"))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every, toxic = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": pa.array(list(every), pa.string()), "n": pa.array(list(every.values()), pa.int64()), "n_toxic": pa.array([toxic[t] for t in every], pa.int64())})
        every.clear()
        toxic.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = terms_of(text or "")
            every.update(t)
            if label:
                toxic.update(t)
            if len(every) >= COUNTER_ENTRIES:
                yield flush()
    yield flush()


def cast_votes(rows: np.ndarray, cols: np.ndarray, terms: list[str], n_words: np.ndarray, n_known: np.ndarray, strength: np.ndarray, voters: int) -> np.ndarray:
    """Rows x voters: TOXIC, CLEAN or SILENT. rows and cols say which terms stand in which row.

    Terms are dealt in turn to the voters of their kind (the fixed list, mined
    words, beginnings of one length), so a voter holds strong and weak ones.
    """
    fixed = set(INSULTS)
    kind = np.array([0 if t in fixed else 1 if not t.endswith("*") else 2 + len(t) - 1 - PREFIXES[0] for t in terms], np.int64)
    kinds = len(PREFIXES) + 2
    each = max(1, voters // (kinds + 1))
    turn = np.zeros(len(terms), np.int64)
    for k in range(kinds):
        own = kind == k
        turn[own] = np.arange(own.sum()) % each
    of_term = kind * each + turn
    hits = np.zeros((len(n_words), kinds * each), np.int64)
    np.add.at(hits, (rows, of_term[cols]), 1)
    long = (n_words >= ENOUGH_WORDS)[:, None]
    by_terms = np.where(hits > 0, TOXIC, np.where(long, CLEAN, SILENT))
    # patterns of the whole text: toxic from a number, sum or share of known words on, clean below a low one, silent between
    share = n_known / np.maximum(1, n_words)
    whole = [(n_known, 0, 2), (n_known, 1, 3), (strength, 4, 8), (strength, 6, 12), (share, 0.005, 0.02)]
    by_text = [np.where(x >= high, TOXIC, np.where((x <= low) & long[:, 0], CLEAN, SILENT)) for x, low, high in whole]
    return np.concatenate([by_terms, np.stack(by_text, 1)], 1)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, voters: int = 24, copies_once: bool = True) -> Model:
    sample = _sample(docs, labels, sample_rows, copies_once)
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = size.get(1, 0), sum(c for k, c in size.items() if k != 1)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model(bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counted = sample.mapInArrow(_count_terms, "term string, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    counted = cut(counted.where("n_toxic > 0"))
    t, c = F.col("n_toxic"), F.col("n") - F.col("n_toxic")
    lean = F.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))
    # how unlikely the toxic share is by chance, in nats; as many terms are tried, chance terms reach the log of their number
    share = n_toxic / (n_toxic + n_clean)
    gain = t * F.log(t / (F.col("n") * share)) + F.when(c > 0, c * F.log(c / (F.col("n") * (1 - share)))).otherwise(0.0)
    least = float(np.log(max(1, counted.count())))
    mined = counted.withColumn("lean", lean).withColumn("gain", gain).where((F.col("lean") > 2) & (F.col("gain") > least)).orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    lexicon = Model(bias=0.0, weights=dict.fromkeys(INSULTS, 3.0) | {r["term"]: r["lean"] for r in mined})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(lexicon.weights)}
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = pa.array([[place[x] for x in lexicon.known(t)] for t in texts], pa.list_(pa.int32()))
            n_words = pa.array([len(_WORD.findall(t)) for t in texts], pa.int32())
            known = [lexicon.words_known(t) for t in texts]
            n_known, strength = pa.array([n for n, _ in known], pa.int32()), pa.array([x for _, x in known], pa.float64())
            yield pa.RecordBatch.from_arrays([found, n_words, n_known, strength], names=["terms", "n_words", "n_known", "strength"])

    got = sample.mapInArrow(find, "terms array<int>, n_words int, n_known int, strength double").collect()  # at most sample_rows short lists
    rows = np.array([i for i, r in enumerate(got) for _ in r["terms"]], np.int64)
    cols = np.array([x for r in got for x in r["terms"]], np.int64)
    votes = cast_votes(rows, cols, list(lexicon.weights), *(np.array([r[c] for r in got]) for c in ("n_words", "n_known", "strength")), voters)
    posterior, _, _ = label_model(votes)
    bias, w = logistic(rows, cols, len(lexicon.weights), posterior)
    return Model(bias=bias, weights=dict(zip(lexicon.weights, w.tolist(), strict=True)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns of docs, or those in ``keep``, and the score, a double from 0 to 1, as ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    own = docs.select(*[F.col(f"`{c}`") for c in keep], *({"text"} - set(keep)))
    at = own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = pa.array([m.score(t or "") for i in range(0, batch.num_rows, 512) for t in batch.column(at).slice(i, 512).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], scores], names=[*keep, name])

    from pyspark.sql import types as T

    return own.mapInArrow(run, T.StructType([*own.schema.fields[: len(keep)], T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, whole."""
    name = unused(docs.columns, "score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) < threshold).drop(name)
