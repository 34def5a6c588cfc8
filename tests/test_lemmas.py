"""Lemmas over a vocabulary, against rules applied word by word."""

import pytest

from tidepool.operators import lemmas

TEXTS = [
    "cat cats bus bu glass glas wolf wolves box boxes church churches lady ladies man men women woman",
    "children feet gas ga mapses maps map yes ye s as ass x9s x9 größes größe lives quiz quizzes",
    "cats cats churches men",
    "cats cats churches men",
    "",
]


def model(texts):
    words = {w for t in texts for w in (t or "").split()}

    def lemma(w):
        if w in lemmas.IRREGULAR:
            return lemmas.IRREGULAR[w]
        ascii_word = w.isascii() and w.isalpha() and w.islower() and not w.endswith("ss")
        found = [w[: -len(a)] + b for a, b in lemmas.SUFFIXES.items() if ascii_word and w.endswith(a)]
        return min([w, *(f for f in found if len(f) >= lemmas.LEAST and f in words)], key=lambda f: (len(f), f))

    return {w: lemma(w) for w in words}


@pytest.mark.parametrize("share", [1e-5, 0.05, 2.0])
def test_lemmas_in_place(spark, monkeypatch, share):
    """With all words hot, some, and none."""
    monkeypatch.setattr(lemmas, "HOT_SHARE", share)
    want = model(TEXTS)
    assert want["cats"] == "cat" and want["bus"] == "bus" and want["wolves"] == "wolf" and want["men"] == "man" and want["ladies"] == "lady" and want["glass"] == "glass"
    rows = spark.createDataFrame([(i, t.split()) for i, t in enumerate(TEXTS)] + [(None, ["cats", None, "feet"]), (99, None)], "n int, tokens array<string>")
    got = {r["n"]: r["tokens"] for r in lemmas.lemmatize(rows, ["n"]).collect()}
    assert got == {i: [want[w] for w in t.split()] for i, t in enumerate(TEXTS)} | {None: ["cat", "foot"], 99: None}


def test_counts_and_empty_table(spark):
    rows = spark.createDataFrame([(t.split(),) for t in TEXTS], "tokens array<string>")
    got = {r["token"]: r["n"] for r in lemmas.lemma_counts(lemmas.vocabulary(rows)).collect()}
    want, all_words = model(TEXTS), [w for t in TEXTS for w in t.split()]
    assert got == {x: sum(want[w] == x for w in all_words) for x in set(want.values())}
    assert lemmas.lemma_counts(lemmas.vocabulary(rows.limit(0))).count() == 0
