"""Filter specifications as one Column, shared by filters and counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import contains_all, tokens


@dataclass(frozen=True)
class Spec:
    """Allowed values by column, closed ranges by column, and words that a text must hold. Empty parts pass all rows."""

    allowed: dict[str, list] = field(default_factory=dict)
    between: dict[str, tuple] = field(default_factory=dict)
    words: str = ""
    text: tuple[str, ...] = ()


def predicate(spec: Spec) -> Column:
    """The conjunction of a specification's parts; nulls don't pass."""
    parts = [F.col(c).isin(*vs) for c, vs in spec.allowed.items() if vs]
    parts += [F.col(c).between(*b) for c, b in spec.between.items()]
    if spec.words.strip():
        parts.append(contains_all(tokens(F.lit(spec.words), 1), F.lower(F.concat_ws(" ", *spec.text))))
    return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def split_list(text: str) -> list[str]:
    """A comma list, trimmed, blanks dropped, the first of equal ones kept."""
    return list(dict.fromkeys(p.strip() for p in text.split(",") if p.strip()))
