"""Wikitext as Spark expressions.  The patterns are parameters, for dialects that differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = r"\[\[(.*?)\]\]"
REDIRECT = r"(?i)^\s*#REDIRECT\s*\[\[(.*?)\]\]"


def capitalize(title: Column) -> Column:
    """The title with its first letter in upper case, all else as it is.

    Only letters of the basic plane that have an upper case of one character change.
    """
    first = F.substring(title, 1, 1)
    upper = F.upper(first)
    plain = (F.char_length(upper) == 1) & (F.octet_length(first) < 4) & (F.octet_length(upper) < 4)
    return F.when(plain, F.concat(upper, title.substr(F.lit(2), F.char_length(title)))).otherwise(title)


def is_redirect(text: Column, pattern: str = REDIRECT) -> Column:
    return text.rlike(pattern)


def redirect_target(text: Column, pattern: str = REDIRECT) -> Column:
    """The title that a redirect names, as written; null if the text is no redirect."""
    return F.when(is_redirect(text, pattern), F.regexp_extract(text, pattern, 1))


def link_titles(text: Column, pattern: str = LINK) -> Column:
    """The distinct titles an article links to: up to the pipe, without those that hold a colon, first letters in upper case."""
    titles = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.substring_index(x, "|", 1))
    return F.array_distinct(F.transform(F.filter(titles, lambda x: ~F.contains(x, F.lit(":"))), capitalize))
