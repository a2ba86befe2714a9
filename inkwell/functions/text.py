"""Building blocks for text expressions. All of them are JVM expressions; patterns are literals, so each is compiled once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def first(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; an empty string if there is none."""
    return F.regexp_extract(c, pattern, group)


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def swap(c: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """Every match replaced by an expression of it. The pattern must not match nothing."""
    gaps, hits = F.split(c, pattern, -1), all_of(c, pattern)
    return F.array_join(F.zip_with(gaps, F.concat(F.transform(hits, by), F.array(F.lit(""))), lambda gap, hit: F.concat(gap, hit)), "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def inner(c: Column) -> Column:
    """Without the first and the last character."""
    return F.substring(c, F.lit(2), F.length(c) - 2)


# The three forms of an option label, where no word, number or hyphen runs into it.
LABEL_FORMS = (r"(?<!-)\({}\)", r"(?<![a-zA-Z0-9-])\b{}\.(?=\s|$)", r"(?<![a-zA-Z0-9(-])\b{}\)(?=\s|$)")


def label(letters: str) -> str:
    """A pattern for an option label: (A), A. or A) and the white space behind; letters is a letter or a class."""
    return f"(?:{'|'.join(form.replace('{}', letters) for form in LABEL_FORMS)})\\s*"
