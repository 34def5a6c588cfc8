"""Word tokens and learnt abbreviations, against loops."""

import math
import re
from collections import Counter

from tidepool.operators import lemmas, words

TEXTS = [
    "Dr. Smith can't pay $1,200.50, e.g. on 12:30; he shouldn't've. Ask Dr. Jones etc. tomorrow.",
    "The end. Of the end (really) -- the end... \"Quoted,\" he said: it's the U.S. way.",
    "Dr. No met Dr. Who, e.g. here, e.g. there. They're at the end. So, at the end.",
    "1,2,3:4:5 a,,b wait... no.",
    "  \n\t ",
    "",
] + [f"word{i} stands here and here and there" for i in range(20)]


def raw(text):
    for _ in range(2):
        text = re.sub(r"(?<=[0-9]),(?=[0-9])", "\x01", text)
        text = re.sub(r"(?<=[0-9]):(?=[0-9])", "\x02", text)
    text = re.sub(r'[!?;,:()\[\]{}<>"“”«»…@#$%&]|--+|\.\.+', lambda m: f" {m[0]} ", text)
    out = []
    for w in text.replace("\x01", ",").replace("\x02", ":").split():
        tail = []
        for _ in range(2):
            m = re.search(r"(?i)(?<=[^\W\d_])(n't|'s|'re|'ve|'ll|'d|'m)$", w)
            if m:
                tail.insert(0, m[0])
                w = w[: m.start()]
        out += [w, *tail]
    return out


def ends(t):
    return len(t) > 1 and t[-1] == "." and t[-2] != "."


def model(texts):
    """(word -> (with, without, score), texts' tokens)."""
    every = [raw(t) for t in texts]
    count = Counter(w for t in every for w in t)
    p = sum(c for w, c in count.items() if ends(w)) / sum(count.values())
    k, m = Counter(), Counter()
    for w, c in count.items():
        word = (w[:-1] if ends(w) else w).lower()
        if word[:1].isalpha() and all(x.isalpha() for x in word.split(".")):
            (k if ends(w) else m)[word] += c
    score = {}
    for w in k:
        n = len(w.replace(".", ""))
        ratio = 2 * (k[w] * math.log(0.99) + m[w] * math.log(0.01) - k[w] * math.log(p) - m[w] * math.log(1 - p))
        score[w] = (k[w], m[w], round(ratio * math.exp(-n) * (w.count(".") + 1) / n ** m[w], 6))
    known = {w for w, s in score.items() if s[2] >= 0.3}
    return score, [[y for w in t for y in ([w[:-1], "."] if ends(w) and w[:-1].lower() not in known else [w])] for t in every]


def test_abbreviations_and_tokens(spark):
    scores, want = model(TEXTS)
    assert scores["dr"][2] >= 0.3 and scores["e.g"][2] >= 0.3 and scores["end"][2] < 0.3 and "ca" in want[0] and "n't" in want[0] and "1,2,3:4:5" in want[3]
    rows = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "n int, text string")
    vocabulary = lemmas.vocabulary(rows.select(words.raw_tokens(rows["text"]).alias("tokens")))
    got = {r["word"]: (r["n_with"], r["n_without"], r["score"]) for r in words.scored(vocabulary).collect()}
    assert got.keys() == scores.keys() and all(got[w][:2] == scores[w][:2] and abs(got[w][2] - scores[w][2]) < 2e-6 for w in got)
    tokens = {r["n"]: r["tokens"] for r in words.tokenize(rows, ["n"]).collect()}
    assert tokens == dict(enumerate(want)) | {99: None}
    counts = {r["token"]: r["n"] for r in words.token_counts(vocabulary).collect()}
    assert counts == Counter(w for t in want for w in t)


def test_no_rows_and_no_periods(spark):
    none = spark.createDataFrame([], "n int, text string")
    assert words.tokenize(none, ["n"]).count() == 0
    plain = spark.createDataFrame([(1, "no period at all")], "n int, text string")
    assert words.tokenize(plain, ["n"]).first()["tokens"] == ["no", "period", "at", "all"]


def test_counts_of_distinct_stretches_are_those_of_texts(spark):
    odd = ["", " ", None, "a", " don't\u2028", "don't\u2028 ", "don't\u2028\n", "don't\u2028x I'd've've", "they're\u0085 we'll\u2029", "it's\u2029", "\x01a\x02 1,2:3,4,5 ,6", "--- -- - ...a. b..", "he said:\"can't!\"\r\nwe're\x0bI'd'd\x0c's 'll x's\r", "don't don't don't", "a\u0085b's\u0085", "'s's's A'S.", "n't\u00a0can't\u00a0"]
    rows = spark.createDataFrame([(t,) for t in TEXTS + odd], "text string")
    want = {r["token"]: r["n"] for r in lemmas.vocabulary(rows.select(words.raw_tokens(rows["text"]).alias("tokens"))).collect()}
    assert {r["token"]: r["n"] for r in words.raw_vocabulary(rows).collect()} == want
    assert words.raw_vocabulary(rows.limit(0)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    both = words.raw_vocabulary(docs), lemmas.vocabulary(docs.select(words.raw_tokens(docs["text"]).alias("tokens")))
    assert both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0
