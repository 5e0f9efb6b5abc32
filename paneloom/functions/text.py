"""Generic text expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; keeps expressions small whose parts are used many times."""
    return F.get(F.transform(F.array(value), body), 0)


def settled(df: DataFrame) -> DataFrame:
    """df with every column computed once a row, here: Catalyst doesn't move expressions over a generator.

    Without it, long expressions over long expressions are put into each other and run again for each
    element of an array.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def strip_markup(html: Column) -> Column:
    """Scripts, styles, comments and tags become spaces, and runs of white space one."""
    bare = F.regexp_replace(html, "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \\t\\r\\n]+", " ")


def sentences(s: Column, stops: str = "[。；;]") -> Column:
    """Parts between stops that hold anything."""
    return F.filter(F.split(s, stops), lambda x: F.trim(x) != "")


def has_positive(s: Column, cue: str, denial: str | None = None, stops: str = "[。；;]") -> Column:
    """Whether a sentence has the cue and not the denial."""
    hit = (lambda x: x.rlike(cue) & ~x.rlike(denial)) if denial else (lambda x: x.rlike(cue))
    return F.coalesce(F.exists(sentences(s, stops), hit), F.lit(False))


def snippet(s: Column, key: str, before: int = 60, after: int = 80) -> Column:
    """Up to `before` characters before the first key and `after` from it on; null without it."""
    at = F.locate(key, s)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(s, start, F.least(at - 1, F.lit(before)) + after))


def normalized(s: Column) -> Column:
    """Without written-out escapes and without white space of any kind."""
    return F.regexp_replace(F.regexp_replace(s, "\\\\[nrtu](?:3000)?", ""), "(?U)[\\s\\u3000\\u00a0\\ufeff]+", "")


def mark(s: Column, pattern: str) -> Column:
    """HTML-escaped, with the matches marked."""
    safe = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.regexp_replace(safe, pattern, "<mark>$0</mark>")
