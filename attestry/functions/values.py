"""Values of fields as columns: templates over captures, radix numbers, list items, spans, spacing."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import rescale


def templated(value: Column | str, cases: Sequence[tuple[str, str]]) -> Column:
    """The first pattern that matches the whole value gives its template; \\1 to \\9 are captures, null if none match."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for pattern, template in reversed(cases):
        whole = f"^(?:{pattern})$"
        pieces = [F.regexp_extract(value, whole, int(p[1])) if re.fullmatch(r"\\[1-9]", p) else F.lit(p) for p in re.split(r"(\\[1-9])", template) if p]
        out = F.when(value.rlike(whole), F.concat(*pieces) if pieces else F.lit("")).otherwise(out)
    return out


def radix(value: Column | str, base: int) -> Column:
    """A number written in a base from 2 to 36; null unless every digit belongs to it."""
    value = F.col(value) if isinstance(value, str) else value
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    return F.when(F.lower(value).rlike(f"^[{digits}]+$"), F.conv(value, base, 10).cast("long"))


def item(values: Column | str, index: Column, base: int = 0) -> Column:
    """The item of a list whose first item has the index base; null outside the list."""
    return F.get(values, index - base)


def span(text: Column | str, start: Column, end: Column, inclusive: bool = False) -> Column:
    """Code points from start (0 is the first) to end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(text, start + 1, end - start + (1 if inclusive else 0))


def spaced(text: Column | str, mark: str) -> Column:
    """Text whose spaces are written with another character."""
    return F.translate(text, mark, " ")


def trimmed(text: Column | str) -> Column:
    """Without white space, no-break spaces included, at both ends."""
    return F.regexp_replace(text, "^[\\s\u00a0]+|[\\s\u00a0]+$", "")


def score(value: Column, low: float, high: float) -> Column:
    """A rescaled score; what is missing counts as a win."""
    return F.coalesce(rescale(value, low, high), F.lit(1.0))
