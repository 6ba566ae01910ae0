"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and underscores, or other characters that are not white space.
#: The white space class holds what Unicode and Python's str.isspace call so.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"
WORD = r"[\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    """Matches of the word-punctuation tokenizer; null text has 0 tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def strip(text: Column) -> Column:
    """Without leading and trailing white space, as Python's str.strip."""
    return F.regexp_replace(F.regexp_replace(text, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+$", "")


def clean_source(source: Column) -> Column:
    """Source names are compared trimmed and in lower case; null stays null."""
    return F.lower(F.trim(source))


def clean_hash(value: Column) -> Column:
    """A content hash without letter case and `sha256:` prefix; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(value)), r"^sha256:", ""), F.lit(""))

#: The accented letters that the index folds, and what they become.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without the accents above."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def index_terms(text: Column) -> Column:
    """Terms of an indexed text: runs of letters and numbers, folded."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def query_tokens(query: Column, most: int = 64) -> Column:
    """Tokens of a query: ASCII words of at least two characters, the first `most`, repeats kept."""
    words = F.regexp_extract_all(query, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: F.length(w) >= 2), 1, most)


def slugify(text: Column) -> Column:
    """Lower case with every other character run as one underscore; `block` if nothing is left."""
    slug = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("block"))


def hard_slices(text: Column, width: int) -> Column:
    """Consecutive slices of `width` characters; none for empty text."""
    last = F.greatest(F.length(text), F.lit(1))
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), last, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(width)))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, stripped, without empty ones; any line ends."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(unix, "\n\n"), strip), lambda p: p != "")


def preview(text: Column, width: int = 80) -> Column:
    """The first characters on one line."""
    return F.translate(F.substring(text, 1, width), "\n", " ")
