"""Text cleaning and tokens."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.session import small_batches

# CJK ideographs and ASCII letters, and everything else.
LETTERS = "([\\u4e00-\\u9fa5a-zA-Z]+)"
NOT_LETTER = "[^\\u4e00-\\u9fa5a-zA-Z]"
NOT_IDEOGRAPH = "[^\\u4e00-\\u9fa5]"
# Fixed value: white space that text trimming removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def clean_text(text: Column) -> Column:
    """Replace every non-letter by a space."""
    return F.regexp_replace(text, NOT_LETTER, " ")


def char_tokens(text: Column) -> Column:
    """One token per letter or ideograph."""
    return F.filter(F.split(F.regexp_replace(text, NOT_LETTER + "+", ""), ""), lambda t: t != "")


def char_counts(text: Column) -> Column:
    """``word, n`` of every token of :func:`char_tokens`, an array without repeats of ASCII letters.

    The letters of ASCII are counted by taking each out of the text, a pass over its bytes;
    ideographs, of which a text has few of a kind, are listed one by one.
    """
    size = F.octet_length(text)
    counted = F.transform(
        F.array(*[F.lit(c) for c in ascii_letters]),
        lambda c: F.struct(c.alias("word"), (size - F.octet_length(F.replace(text, c, F.lit("")))).cast("bigint").alias("n")),
    )
    listed = F.transform(
        F.filter(F.split(F.regexp_replace(text, NOT_IDEOGRAPH + "+", ""), ""), lambda t: t != ""),
        lambda t: F.struct(t.alias("word"), F.lit(1).cast("bigint").alias("n")),
    )
    return F.concat(F.filter(counted, lambda e: e["n"] > 0), listed)


def word_tokens(text: Column) -> Column:
    """Runs of letters between non-letters."""
    return F.regexp_extract_all(text, F.lit(LETTERS), 1)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"char": char_tokens, "word": word_tokens}


def tokens(text: Column, tokenizer: str | Callable[[Column], Column] = "char") -> Column:
    """Token array by a named tokenizer or a user function on the cleaned text.

    A user function may be a pandas UDF from STRING to ARRAY<STRING>; blank
    tokens it returns are dropped. Python is given few texts at a time (``small_batches``).
    """
    if callable(tokenizer):
        small_batches()
        return F.filter(tokenizer(clean_text(text)), lambda t: ~is_blank(t))
    return TOKENIZERS[tokenizer](text)


def path_stem(path: Column) -> Column:
    """File name without directories and last extension."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")
