"""Text Columns: white space as Python has it, tokens, sentences, truncation and escaping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() and str.split() take for white space: a pattern, and its characters.
SPACE = r"(?U)[\s\x1c-\x1f]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# What pads a summary that is short of sentences.
SENTENCE_PADS = (
    "This update is relevant to current AI developments.",
    "The linked source provides additional technical and business context.",
    "Read the full article for complete details and implications.",
)


def present(x: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    return F.rtrim(F.ltrim(x, F.lit(BLANKS)), F.lit(BLANKS))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def split_words(x: Column) -> Column:
    """The runs of anything but white space."""
    return F.filter(F.split(x, SPACE + "+"), lambda w: w != "")


def collapse(x: Column) -> Column:
    return F.array_join(split_words(x), " ")


def words(x: Column) -> Column:
    """The runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def normalize_text(x: Column) -> Column:
    """The words with a blank between each two."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(x: Column, stopwords) -> Column:
    """The distinct words that aren't stopwords."""
    return F.array_except(words(x), literal_array(stopwords))


def split_sentences(x: Column) -> Column:
    """The text cut at white space behind a full stop, an exclamation or a question mark."""
    return F.filter(F.split(collapse(x), r"(?<=[.!?])\s+"), lambda s: s != "")


def enforce_sentences(x: Column, count: int = 3) -> Column:
    """The first `count` sentences; missing ones are padded by place, in turn."""
    pads = literal_array([SENTENCE_PADS[i % len(SENTENCE_PADS)] for i in range(count)])
    have = F.slice(split_sentences(F.coalesce(x, F.lit(""))), 1, count)
    return F.array_join(F.zip_with(have, pads, lambda h, p: F.coalesce(h, p)), " ")


def count_sentences(text: str) -> int:
    """How many sentences split_sentences finds, for a text that is not in a table."""
    return len([s for s in re.split(r"(?<=[.!?])\s+", " ".join(text.split())) if s])


def truncate(x: Column, limit: Column | int) -> Column:
    """The text if it has at most `limit` code points, else cut to that many, three dots included where they fit."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    cut = F.concat(rstrip(F.substring(x, F.lit(1), F.greatest(limit - 3, F.lit(0)))), F.lit("..."))
    return F.when(F.char_length(x) <= limit, x).when(limit <= 3, F.substring(x, F.lit(1), F.greatest(limit, F.lit(0)))).otherwise(cut)


def escape_html(x: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])]
    for char, entity in pairs:
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x
