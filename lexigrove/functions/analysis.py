"""Text analysis as column expressions: tokens, types and occurrences.

Everything but the stemmer stays in the JVM.  Regular expressions run on
exploded rows, where generated code evaluates them, not inside lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Python's str.isspace has it, and the line ends of str.splitlines in Java's syntax.
_SPACE_POINTS = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = "".join(map(chr, _SPACE_POINTS))
LINE_ENDS = r"\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029"

#: What separates tokens, by document format; formats that aren't listed are read like ``txt``.
SEPARATORS = {"json": " ", "xml": f"[ {LINE_ENDS}]", "txt": r"[ \n\r]"}
FORMATS = ("txt", "json", "xml", "table")


def pieces(content: Column, fmt: Column) -> Column:
    """Content cut at its format's separators."""
    out = F.split(content, SEPARATORS["txt"], -1)
    for name in ("json", "xml"):
        out = F.when(fmt == name, F.split(content, SEPARATORS[name], -1)).otherwise(out)
    return out


def strip(text: Column) -> Column:
    """Text without outer white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def tokens(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(doc_id, position, token)`` of ``documents(doc_id, content, format)``; positions count from 1.

    Null and blank contents have no tokens.  ``keep`` names the columns that stay.
    """
    # The outer form keeps the optimizer from cutting every text a second time to test for emptiness.
    words = F.filter(F.transform(pieces(F.col("content"), F.col("format")), strip), lambda t: t != "")
    rows = documents.select(*keep, F.posexplode_outer(words).alias("at", "token"))
    return rows.where("token IS NOT NULL").select(*keep, (F.col("at") + 1).alias("position"), "token")


def expand_hyphens(token: Column) -> Column:
    """The token, or for a hyphenated one its parts followed by the parts run together."""
    parts = F.concat(F.split(token, "-", -1), F.array(F.replace(token, F.lit("-"), F.lit(""))))
    return F.when(F.contains(token, F.lit("-")), parts).otherwise(F.array(token))


def clean_type(raw: Column) -> Column:
    """Edges trimmed to ASCII letters and digits; quotes, spaces and non-ASCII characters deleted; lower case."""
    trimmed = F.regexp_replace(raw, "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "")
    unquoted = F.translate(trimmed, "\"' ", "")
    cleaned = F.lower(F.regexp_replace(unquoted, r"[^\x00-\x7F]+", ""))
    # Most types are clean already, which one look without a copy tells.
    return F.when(raw.rlike("^[a-z0-9]++$"), raw).otherwise(cleaned)


def types(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(doc_id, position, term)`` before stemming; all types of a token share its position, empty ones stay."""
    raw = tokens(documents, keep).select(*keep, "position", F.explode(expand_hyphens(F.col("token"))).alias("raw"))
    return raw.select(*keep, "position", clean_type(F.col("raw")).alias("term"))


def spanish_types(documents: DataFrame) -> DataFrame:
    """``(doc_id, position, term)`` of words of letters only, lower-cased, with their accents.

    An approximation by regular expression of a statistical tokenizer; positions
    count all words, also those with digits.
    """
    words = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0))
    rows = documents.select("doc_id", F.posexplode_outer(words).alias("at", "token")).where("token IS NOT NULL")
    return rows.select("doc_id", (F.col("at") + 1).alias("position"), F.lower("token").alias("term")).where(F.col("term").rlike(r"^\p{L}+$"))


def lemmatize(rows: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """Replace terms by their lemma in ``lemmas(form, lemma)``; terms that aren't listed stay."""
    if lemmas is None:
        return rows
    unique = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    return rows.join(unique, rows["term"] == unique["form"], "left").select("doc_id", "position", F.coalesce("lemma", "term").alias("term"))


# Frequent words that tell two languages apart.
FREQUENT = {
    "english": ["the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "was", "on", "are", "by", "this"],
    "spanish": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "del", "se", "es"],
}


def language_name(text: Column) -> Column:
    """``spanish`` where its frequent words are in the majority, else ``english``."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")

    def hits(name: str) -> Column:
        known = F.array(*map(F.lit, FREQUENT[name]))
        return F.size(F.filter(words, lambda w: F.array_contains(known, w)))

    return F.when(hits("spanish") > hits("english"), "spanish").otherwise("english")


def spelling_words(query: Column) -> Column:
    """Words of a query of which only ASCII letters are left."""
    return F.filter(F.split(F.regexp_replace(query, r"[^a-zA-Z\s]", ""), r"\s+"), lambda w: w != "")
