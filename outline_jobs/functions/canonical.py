"""JSON as columns with one spelling for each value: sorted keys, code points as they are, only what must be escaped is.

Spark's own writer gives neither keys in order nor a choice of separators, and spells control signs with capital digits; so objects are
put together from their parts, and only strings and numbers come from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    """What stands between items and after keys."""

    comma: str
    colon: str


#: Without spaces, as requests are measured; with spaces, as fingerprints are taken.
COMPACT, SPACED = Style(",", ":"), Style(", ", ": ")

#: Control signs whose code has a letter: JSON writers differ in its case.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def quoted(c: Column) -> Column:
    """A string, number or truth value; null is null."""
    json = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    inner = F.substring(json, F.lit(2), F.length(json) - 2)
    lower = inner
    for code in _LETTERED:  # a backslash that is itself escaped begins no code
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.when(inner.contains("\\u00"), lower).otherwise(inner)


def array_of(items: Column, style: Style) -> Column:
    """items: an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, style.comma), F.lit("]"))


def strings(c: Column, style: Style) -> Column:
    """An array of strings or numbers; null is an empty one."""
    return F.coalesce(array_of(F.transform(c, quoted), style), F.lit("[]"))


def object_of(fields: dict[str, Column], style: Style, only: dict[str, Column] | None = None) -> Column:
    """An object of JSON texts by key; a key of `only` is left out of rows where its condition does not hold."""
    parts = []
    for key in sorted(fields):
        pair = F.concat(F.lit(f'"{key}"{style.colon}'), fields[key])
        parts.append(F.when(only[key], pair) if only and key in only else pair)
    return F.concat(F.lit("{"), F.concat_ws(style.comma, *parts), F.lit("}"))
