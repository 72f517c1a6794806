"""String measurements as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def chars_left(col: Column, removed: str) -> Column:
    """Length of the text once every character of ``removed`` is deleted."""
    return F.length(F.translate(col, removed, ""))


def count_of(col: Column, alphabet: str) -> Column:
    """How many characters belong to an ASCII alphabet."""
    return F.length(col) - chars_left(col, alphabet)


def count_matching(col: Column, char_class: str) -> Column:
    """How many characters match a (Unicode) character class."""
    return F.regexp_count(col, F.lit(char_class))


def characters(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def distinct_characters(col: Column) -> Column:
    return F.array_distinct(characters(col))


# c * log2(c) for the character counts that occur in names.
_WEIGHT_TABLE = "array(" + ", ".join(f"{0.0 if c < 2 else c * math.log2(c)!r}D" for c in range(64)) + ")"


def shannon_entropy(col: Column) -> Column:
    """Bits per character: log2(n) - sum(c * log2 c) / n; 0 for empty text."""
    n = F.length(col)
    table = F.expr(_WEIGHT_TABLE)

    def weighted(char: Column) -> Column:
        c = n - F.length(F.replace(col, char, F.lit("")))
        return F.coalesce(F.get(table, c), c * F.log2(c.cast("double")))

    total = F.aggregate(F.array_distinct(F.split(col, "")), F.lit(0.0), lambda acc, ch: acc + weighted(ch))
    bits = F.log2(n.cast("double")) - total / n
    return F.when((n > 1) & (bits > 0), bits).otherwise(F.lit(0.0))


def longest_run(col: Column, char_class: str) -> Column:
    runs = F.regexp_extract_all(col, F.lit(f"({char_class}+)"), F.lit(1))
    return F.aggregate(runs, F.lit(0), lambda acc, r: F.greatest(acc, F.length(r)))


def constant_words(words: list[str]) -> Column:
    """A constant array, folded by the optimizer (one literal to build)."""
    return F.split(F.lit("|".join(words)), r"\|") if words else F.array().cast("array<string>")


def contains_any(col: Column, words: list[str]) -> Column:
    """True if any word occurs.  A constant array keeps the generated code
    small; unrolled tests would push the whole stage out of codegen."""
    return F.exists(constant_words(words), lambda w: F.contains(col, w))


def count_contained(col: Column, words: list[str]) -> Column:
    return F.size(F.filter(constant_words(words), lambda w: F.contains(col, w)))


def contained_words(col: Column, words: list[str]) -> Column:
    """The words that occur, alphabetically."""
    return F.filter(constant_words(sorted(words)), lambda w: F.contains(col, w))


def longest_contained(col: Column, words: list[str]) -> Column:
    """The longest word that occurs (ties alphabetical), or null."""
    longest = constant_words(sorted(words, key=lambda w: (-len(w), w)))
    return F.get(F.filter(longest, lambda w: F.contains(col, w)), F.lit(0))


def flag(condition: Column) -> Column:
    """Boolean to 0/1, null counting as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")
