"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and formats that results depend on.
NUMBERED = r"\d+\.\s(.*?)(?=\n\d+\.|\n|$)"
MARKED = r"(?i)standalone[^\n]*:[^\n](.*)"
PREFIX = r"^\((\d+)\)\.? ?|^\d+\.? ?\)?|^(\d+)\) ?|^(\d+)\) ?|^[Qq]uery \d+: ?|^[Qq]uery: ?"
ID_LIST = r"\[\s*\d+\s*(?:,\s*\d+\s*)*\]"
SPEAKERS = {"human": "Human: ", "ai": "Assistant: "}
SNIPPET = "Context {i}:\n{{{text}}}. {{source: {source}}}"
FILE_CONTEXT = "\nContext about {file}:\n{{{texts}}}\n"

PUNCTUATION = r"[!-/:-@\[-`{-~]+"
#: A whole token of letters alone, of digits alone, or with a digit and an ASCII letter.
KEPT = r"(?<!\S)(?:\p{L}++|\p{Nd}++|(?=\S*?[0-9])(?=\S*?[a-zA-Z])\S++)(?!\S)"
SPACES = r"[ \t\n\r\f\x0B]+"
#: Common English function words that the lexical search skips.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with would you your yours yourself yourselves"
).split()

Lemmatizer = Callable[[Column], Column]


def clean_tokens(text: Column, lemmatize: Lemmatizer | None = None) -> Column:
    """Tokens for lexical search.

    ``[SEP]`` goes, letters are lower-cased, ASCII punctuation is stripped, and
    of the white-space separated rest only all-letter, all-digit and mixed
    tokens stay that are no English stop words. ``lemmatize`` maps a token.
    """
    plain = F.regexp_replace(F.lower(F.replace(text, F.lit("[SEP]"), F.lit(""))), PUNCTUATION, "")
    kept = F.filter(F.regexp_extract_all(plain, F.lit(KEPT), F.lit(0)), lambda w: ~w.isin(STOPWORDS))
    return F.transform(kept, lemmatize) if lemmatize else kept


def clean_text(text: Column, lemmatize: Lemmatizer | None = None) -> Column:
    return F.array_join(clean_tokens(text, lemmatize), " ")


def words(text: Column) -> Column:
    """White-space separated words; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title(path: Column) -> Column:
    """The base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """What follows the last dot, case kept."""
    return F.element_at(F.split(path, r"\."), -1)


def standalone_questions(answer: Column, at_most: int = 3) -> Column:
    """Questions in a model's answer: numbered items, else the lines behind a 'standalone ...:' mark, else all lines."""
    # UNIX_LINES: a carriage return is no line end here
    numbered = F.regexp_extract_all(answer, F.lit("(?d)" + NUMBERED), F.lit(1))
    marked = "(?s)" + MARKED
    source = F.when(answer.rlike(marked), F.btrim(F.regexp_extract(answer, marked, 1), F.lit(" \t\n\r\x0b\x0c"))).otherwise(answer)
    lines = F.filter(F.transform(F.split(source, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))), lambda x: x != "")
    plain = F.transform(lines, lambda x: F.regexp_replace(x, PREFIX, ""))
    return F.slice(F.when(F.size(numbered) > 0, numbered).otherwise(plain), 1, at_most)


def chosen_ids(answer: Column) -> Column:
    """The first bracketed list of numbers in a model's answer; an empty array if there is none."""
    numbers = F.regexp_extract_all(F.regexp_extract(answer, ID_LIST, 0), F.lit(r"\d+"), F.lit(0))
    return F.transform(numbers, lambda x: x.cast("int"))


def strip_speaker(line: Column) -> Column:
    return F.regexp_replace(line, "^" + SPEAKERS["human"], "")


def speaker(role: Column) -> Column:
    known = F.when(role.isin("human", "user"), SPEAKERS["human"]).when(role.isin("ai", "assistant"), SPEAKERS["ai"])
    return known.otherwise(F.concat(role, F.lit(": ")))


def model_parts(name: Column) -> Column:
    """provider|model|file as an array."""
    return F.split(name, r"\|")


def _fill(form: str, **values: Column) -> Column:
    """A format with columns for its fields."""
    parts = [c for text, field, _, _ in Formatter().parse(form) for c in ([F.lit(text)] if text else []) + ([values[field]] if field else [])]
    return F.concat(*parts)


def snippet(i: Column, text: Column, source: Column) -> Column:
    """A numbered context for the model that selects."""
    return _fill(SNIPPET, i=i.cast("string"), text=text, source=source)


def file_context(file: Column, texts: Column) -> Column:
    """A file's texts for the model that answers."""
    return _fill(FILE_CONTEXT, file=file, texts=texts)
