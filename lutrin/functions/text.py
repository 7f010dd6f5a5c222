"""Column functions on text: JVM expressions, except where the semantics need Python."""

from __future__ import annotations

import textwrap
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space that str.strip removes, as a Java character class.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"\A{SPACE}+", ""), rf"{SPACE}+\z", "")


def leading(c: Column) -> Column:
    """Number of white-space characters at the start."""
    return F.length(c) - F.length(F.regexp_replace(c, rf"\A{SPACE}+", ""))


def bullets(c: Column) -> Column:
    """Private-use glyphs U+F000 to U+F0FF, which symbol fonts leave behind, as bullets."""
    return F.regexp_replace(c, r"[\uF000-\uF0FF]", "• ")


def whitespace(c: Column) -> Column:
    """Line ends as line feeds; blanks and tabs inside a line as one space; lines and text stripped;
    three or more line feeds as two."""
    lines = F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n", -1)
    joined = F.array_join(F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t]+", " "))), "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def page_text(c: Column) -> Column:
    return whitespace(bullets(c))


def alpha_ratio(c: Column) -> Column:
    """Share of letters; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)).otherwise(F.lit(0.0))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_pattern():
    """The same words as a Python pattern, for texts that a worker counts."""
    import regex

    return regex.compile(r"[\p{L}\p{N}_]+")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=.)\.[^.]*$", "")


def shortened(c: Column, most: int = 100) -> Column:
    """At most `most` characters, the last three as dots where text was cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def abbreviated(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width - 1, F.concat(F.substring(c, 1, width - 2), F.lit("…"))).otherwise(c)


def band(score: Column) -> Column:
    return F.when(score >= 0.8, F.lit("green")).when(score >= 0.5, F.lit("yellow")).otherwise(F.lit("red"))


def bar(score: Column, width: int = 8) -> Column:
    full = F.bround(score * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def plain_markdown(c: Column) -> Column:
    """Text without bold and italic marks, with list marks as bullets and Windows paths as file names."""
    # The four patterns.
    c = F.regexp_replace(c, r"(?d)\*\*(.*?)\*\*", "$1")
    c = F.regexp_replace(c, r"(?d)\*(.*?)\*", "$1")
    c = F.regexp_replace(c, r"(?md)^[ \t]*[*\-][ \t]+", "• ")
    return F.regexp_replace(c, r'[A-Za-z]:\\(?:[^\\<>:"/|?*\n]+\\)+([^\\<>:"/|?*\n]+)', "$1")


@F.pandas_udf(T.StringType())
def excerpt(c: pd.Series) -> pd.Series:
    """At most 500 characters of whole words, blanks collapsed; Spark's functions cannot say where it cuts."""
    return c.map(lambda t: None if t is None else textwrap.shorten(t, 500, placeholder="..."))


@F.pandas_udf(T.StringType())
def _composed(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """Unicode composition (NFC); only texts with combining marks leave the JVM."""
    return F.when(c.rlike(r"[\x{300}-\x{36f}]"), _composed(F.when(c.rlike(r"[\x{300}-\x{36f}]"), c))).otherwise(c)


def collapsed(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"{SPACE}+", " "))


def excerpted(c: Column) -> Column:
    """excerpt; only contents over 500 characters go to Python."""
    short = collapsed(c)
    return F.when(F.length(short) <= 500, short).otherwise(excerpt(F.when(F.length(short) > 500, c)))


def term_counts(c: Column) -> Column:
    """array<struct<term, tf>> of a text, counted inside its row: no shuffle by (text, term).

    In the sorted terms joined by spaces, a term with its repetitions is one match of a back-reference.
    """
    joined = F.array_join(F.array_sort(tokens(c)), " ")
    runs = F.regexp_extract_all(joined, F.lit(r"(?<![^ ])([^ ]++)(?: \1(?![^ ]))*+"), F.lit(0))
    one = lambda r: F.substring_index(r, " ", 1)
    return F.transform(runs, lambda r: F.struct(one(r).alias("term"), ((F.length(r) + 1) / (F.length(one(r)) + 1)).cast("int").alias("tf")))
