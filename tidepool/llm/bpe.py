"""Byte-pair encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that stands inside no token of the vocabulary is a
certain cut: every merge makes a token of the vocabulary, so none can join the
two. A word (what the tokenizer's own split yields) is cut there, each fragment
is merged alone by the tokenizers library, once however often it occurs, and the
ids are put side by side. A word's last byte carries the end mark, so pairs that
end a word are told apart from pairs within one.

Documents are encoded where they lie: nothing is shuffled. A worker remembers
the ids of space-separated chunks and of fragments, and starts anew beyond
``CACHE_STRINGS`` of them or ``CACHE_IDS`` ids, so its memory is bounded.

Defined results: a null or empty text has no ids, and null ids decode to the
empty text. Special tokens that stand in a text get their own ids. Ids that the
vocabulary doesn't hold are left out by ``decode``. Rows are encoded each on its
own, so repeated rows and ties need no rule. Texts of any length are encoded
whole, as long as a batch's ids fit a worker. Other columns pass through
``encode``, ``decode`` and both in one, but for those that have the names of their results,
which are replaced. Empty tables give no rows.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import unused
from tidepool.llm.packing import WordCache, has_known_rules

END = "</w>"
#: Chunks and fragments, and their ids, that a worker remembers before it starts anew.
CACHE_STRINGS, CACHE_IDS = 600_000, 8_000_000
#: Fixed value: the tokenizer's split of printable ASCII in lower case, without spaces.
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The letters that stand for bytes have smaller code points.
LETTERS = 1 << 9


class _Numbers(dict):
    """Numbers strings as they are first seen, from a counter that several share, and notes them."""

    def __init__(self, counter: Iterator[int]):
        super().__init__()
        self.counter = counter
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        n = self[text] = next(self.counter)
        self.fresh.append(text)
        return n


class Encoder(WordCache):
    """Ids of texts, chunk by chunk; new chunks are cut at forced boundaries, and each new fragment is merged once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not has_known_rules(path):
            raise ValueError(f"{path}: only tokenizers with the rules of packing.has_known_rules are encoded")
        rules, model = _rules(path)
        self.special = {t["content"]: t["id"] for t in rules.get("added_tokens", ())}
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # joined[0, a, b]: letters a, b stand together in a token; joined[1, a, b]: they do so where b ends a word
        self.joined = np.zeros((2, LETTERS, LETTERS), bool)
        for token in model["vocab"]:
            body = token.removesuffix(END)
            for i in range(len(body) - 1):
                self.joined[int(token.endswith(END) and i == len(body) - 2), ord(body[i]), ord(body[i + 1])] = True
        # the merges alone, for fragments that end a word and for those within one
        bare = rules | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
        self.merge = {ends: Tokenizer.from_str(json.dumps(bare | {"model": model | {"end_of_word_suffix": END if ends else None}})) for ends in (True, False)}
        super().__init__(path)

    def _clear(self) -> None:
        super()._clear()
        counter = itertools.count()
        self.index = _Numbers(counter)
        self.known = {True: _Numbers(counter), False: _Numbers(counter), None: _Numbers(counter)}  # fragments by whether they end a word; special tokens
        for t, i in self.special.items():
            self._store([self.known[None][t]], np.array([1]), np.array([i]))

    def _strings(self) -> int:
        return len(self.index) + sum(map(len, self.known.values()))

    def _room(self, ids: int) -> None:
        while self._strings() > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        super()._room(ids)

    def _store(self, slots: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the slots, side by side."""
        self._room(len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[slots] = self.used + np.cumsum(sizes) - sizes
        self.sizes[slots] = sizes
        self.used += len(ids)

    def cuts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Certain cuts of words, given in the vocabulary's letters for bytes: the word's number and the place in it."""
        letters = np.frombuffer("".join(words).encode("utf-16-le"), "<u2").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(words)), size)
        last = np.zeros(len(letters), np.int64)
        last[ends - 1] = 1
        at = np.flatnonzero((owner[1:] == owner[:-1]) & ~self.joined[last[1:], letters[:-1], letters[1:]]) + 1
        return owner[at], at - (ends - size)[owner[at]]

    def fragments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word's number, slot) of each fragment, in order."""
        word, place = self.cuts(words)
        n = np.bincount(word, minlength=len(words))
        whole, ending, inside = np.flatnonzero(n == 0), self.known[True], self.known[False]
        first = np.cumsum(n + 1) - (n + 1)
        slots = np.empty(len(words) + len(word), np.int64)
        slots[first[whole]] = np.fromiter(map(ending.__getitem__, map(words.__getitem__, whole.tolist())), np.int64, len(whole))
        at, places = 0, place.tolist()
        for i in np.flatnonzero(n).tolist():
            w, own = words[i], places[at : at + n[i]]
            at += len(own)
            parts = [inside[w[a:b]] for a, b in zip([0, *own[:-1]], own, strict=True)]
            slots[first[i] : first[i] + len(own) + 1] = [*parts, ending[w[own[-1] :]]]
        return np.repeat(np.arange(len(words)), n + 1), slots

    def _words(self, chunks: list[str]) -> tuple[np.ndarray, list[str]]:
        """(chunk's number, word) of chunks without white space or special tokens."""
        plain = [i for i, c in enumerate(chunks) if c.isascii() and c.isprintable()]
        if len(plain) < len(chunks):
            other = sorted(set(range(len(chunks))).difference(plain))
            owner, words = self._split([chunks[i] for i in other])
            own, more = self._words([chunks[i] for i in plain]) if plain else (np.empty(0, np.int64), [])
            return np.concatenate([np.array(other, np.int64)[owner], np.array(plain, np.int64)[own]]), words + more
        # printable ASCII letters stand for themselves
        each = list(map(ASCII_WORDS.findall, "\n".join(chunks).lower().split("\n")))
        return np.repeat(np.arange(len(chunks)), list(map(len, each))), list(itertools.chain.from_iterable(each))

    def _split(self, chunks: list[str]) -> tuple[np.ndarray, list[str]]:
        """The same by the tokenizer's own steps: chunks are split in one call, and told apart by character place."""
        plain = self.tokenizer.normalizer.normalize_str("\n".join(chunks))
        parts = plain.split(" ")
        if len(parts) != len(chunks):
            each = [self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c)) for c in chunks]
            return np.repeat(np.arange(len(chunks)), list(map(len, each))), [w for ws in each for w, _ in ws]
        found = self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        return np.searchsorted(ends, np.array([o[0] for _, o in found], np.int64), side="right"), [w for w, _ in found]

    def _learn(self) -> None:
        fresh, self.index.fresh = self.index.fresh, []
        owners, slots = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(fresh), 4096):
            block = fresh[at : at + 4096]
            odd = {i for i, c in enumerate(block) if "<" in c or c.split() != [c]}
            easy = np.array([i for i in range(len(block)) if i not in odd], np.int64)
            chunk, words = self._words([block[i] for i in easy]) if len(easy) else (np.empty(0, np.int64), [])
            word, slot = self.fragments(words)
            owners.append(at + easy[chunk[word]])
            slots.append(slot)
            for i in sorted(odd):  # special tokens are found first, in the text as it is
                for j, part in enumerate(self.find_special.split(block[i]) if self.special else [block[i]]):
                    slot = np.array([self.known[None][part]]) if j % 2 else self.fragments(self._words([part])[1])[1]
                    owners.append(np.full(len(slot), at + i))
                    slots.append(slot)
        self._merge_new()
        owner, slot = np.concatenate(owners), np.concatenate(slots)
        order = np.argsort(owner, kind="stable")
        owner, slot = owner[order], slot[order]
        self._room(0)
        sizes = np.bincount(owner, weights=self.sizes[slot], minlength=len(fresh)).astype(np.int64)
        self._store([self.index[w] for w in fresh], sizes, self._ids(slot))

    def _merge_new(self) -> None:
        for ends, merge in self.merge.items():
            new, self.known[ends].fresh = self.known[ends].fresh, []
            for at in range(0, len(new), 4096):
                block = new[at : at + 4096]
                enc = merge.encode(block, is_pretokenized=True, add_special_tokens=False)
                self._store([self.known[ends][t] for t in block], np.bincount(np.array(enc.word_ids, np.int64), minlength=len(block)), np.array(enc.ids, np.uint32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.used > CACHE_IDS or self._strings() > CACHE_STRINGS:
            self._clear()
        return super().encode(texts)


def _rules(path: str) -> tuple[dict, dict]:
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model = rules["model"]
    if model.get("end_of_word_suffix") != END or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        raise ValueError(f"{path}: a byte-pair model with the end mark {END} is needed")
    return rules, model


_ENCODERS: dict[str, Encoder] = {}
_TOKENS: dict[str, pa.Array] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, which serves the tasks that it runs in turn."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _token_table(path: str) -> pa.Array:
    """Each id's token in the id's place; null where the vocabulary has none."""
    if path not in _TOKENS:
        rules, model = _rules(path)
        by_id = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in rules.get("added_tokens", ())}
        _TOKENS[path] = pa.array([by_id.get(i) for i in range(max(by_id, default=-1) + 1)], pa.large_string())
    return _TOKENS[path]


def _with_columns(df: DataFrame, source: str, kinds: dict[str, str], compute) -> DataFrame:
    """``compute`` makes Arrow arrays, one a name of kinds, of the source column, some hundred rows at a time; the other columns pass through."""
    held = unused(df.columns, "source_column")
    replaced = {c.lower() for c in kinds}
    others = [c for c in df.columns if c.lower() not in replaced]
    # names could be equal but for their case: they go by place
    given = df.select(F.col(f"`{source}`").alias(held), *[F.col(f"`{c}`") for c in others])
    schema = given.drop(held).select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *compute(part.column(0))], names=[*part.schema.names[1:], *kinds])

    return given.mapInArrow(run, schema)


def _ids_of(texts: pa.Array, path: str) -> pa.Array:
    found = encoder(path).encode([t or "" for t in texts.to_pylist()])
    ends = np.cumsum([0, *map(len, found)])
    if ends[-1] > 2**31 - 1:
        raise ValueError("the texts of one batch have over 2^31 tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def _text_of(ids: pa.Array, path: str) -> pa.Array:
    table = _token_table(path)
    flat, sizes = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    number = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
    known = (number >= 0) & (number < len(table))
    known[known] = table.is_valid().to_numpy(zero_copy_only=False)[number[known]]
    owner = np.repeat(np.arange(len(ids)), sizes)[known]
    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(ids))))
    tokens = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), table.take(pa.array(number[known])))
    return pc.binary_join(tokens, pa.scalar(" ", pa.large_string())).cast(pa.string())


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with an array<int> of each text's token ids, as the tokenizers library gives them without added special tokens."""
    return _with_columns(docs, text_col, {ids_col: "array<int>"}, lambda texts: [_ids_of(texts, tokenizer_path)])


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids: the tokens' own letters, parted by spaces, as this tokenizer has no decoder."""
    return _with_columns(rows, ids_col, {text_col: "string"}, lambda ids: [_text_of(ids, tokenizer_path)])


def encode_and_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``decode`` of ``encode`` in one pass: a task has one worker, and ids don't leave it to come back."""

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = _ids_of(texts, tokenizer_path)
        return [ids, _text_of(ids, tokenizer_path)]

    return _with_columns(docs, text_col, {ids_col: "array<int>", decoded_col: "string"}, both)
