"""Arrays, maps and JSON texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(items: Column) -> Column:
    """Trimmed, blanks dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def run_length_dedupe(items: Column) -> Column:
    """One of each run of equal neighbours."""
    return F.filter(items, lambda x, k: (k == 0) | ~x.eqNullSafe(F.get(items, k - 1)))


def keys_where(m: Column, test) -> Column:  # noqa: ANN001
    """Sorted keys of the map entries that pass."""
    return F.array_sort(F.map_keys(F.map_filter(m, test)))


def has_evidence(m: Column, keys: list[str]) -> Column:
    """Every key has an entry with at least one item."""
    return F.forall(F.lit(keys), lambda k: F.coalesce(F.size(F.try_element_at(m, k)) > 0, F.lit(False)))


def errors(*rules: tuple[str, Column]) -> Column:
    """The codes of the (code, condition) rules that hold, in order; null conditions don't hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))


def first_number(*columns: Column) -> Column:
    """The first value that is a finite number, 0 if none is."""
    values = [c.try_cast("double") for c in columns]
    return F.coalesce(*[F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v) for v in values], F.lit(0.0))


def json_int(text: Column, key: str) -> Column:
    """An integer member of a JSON text; null for texts that are no JSON."""
    return F.get_json_object(text, f"$.{key}").try_cast("long")
