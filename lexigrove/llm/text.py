"""Column expressions shared by the operators on training text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str.isspace has it, for Java's regular expressions.
SPACE = r"[\t\n\x0B\f\r\x1c-\x1f \x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def or_empty(column: Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(column, F.lit(""))


def letters_and_digits(column: Column) -> Column:
    """Lower-cased text without anything but letters and digits."""
    return F.regexp_replace(F.lower(or_empty(column)), r"[^\p{L}\p{N}]+", "")


def words_text(column: Column) -> Column:
    """Longest runs of letters and digits, lower-cased, with one space between."""
    return F.trim(F.regexp_replace(F.lower(or_empty(column)), r"[^\p{L}\p{N}]+", " "))


def plain_line(column: Column) -> Column:
    """A line trimmed, with single spaces, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(column, SPACE + "+", " ")))


def clean_source(column: Column) -> Column:
    """A source's name without outer white space and case; empty names are null."""
    name = F.lower(F.regexp_replace(column, f"^{SPACE}+|{SPACE}+$", ""))
    return F.when(name != "", name)
