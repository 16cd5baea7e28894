"""Nested JSON as rows: providers' payloads, aliases of keys, maps and arrays of entries, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """An inline JSON array of objects as a typed table; missing members are null."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def nested_rows(payloads: DataFrame, text: str, schema: str, path: str, carry: list[str]) -> DataFrame:
    """One row for each item of an array inside JSON payloads; payloads without it (or no JSON) have none."""
    items = F.from_json(F.col(text), schema)
    for step in path.split("."):
        items = items[step]
    return payloads.select(*carry, F.inline(items))


def either(entry: Column, *names: str) -> Column:
    """The first member that isn't null among several spellings of its name."""
    return F.coalesce(*[entry[n] for n in names])


def other_spelling(name: str) -> str:
    """pricePerDay for price_per_day."""
    first, *rest = name.split("_")
    return first + "".join(p.capitalize() for p in rest)


def coalesce_spellings(obj: Column, names: list[str]) -> Column:
    """A JSON object's members under their snake-case names, whichever spelling they have; as texts."""
    return F.struct(*[F.coalesce(F.get_json_object(obj, f"$.{n}"), F.get_json_object(obj, f"$.{other_spelling(n)}")).alias(n) for n in names])


def entries_to_map(entries: Column, key: str, value: str) -> Column:
    """An array of structs as a map; the LAST entry of a key wins; entries without key are dropped."""
    good = F.filter(entries, lambda e: e[key].isNotNull())
    last = F.filter(good, lambda e, k: ~F.exists(F.slice(good, k + 2, F.greatest(F.size(good) - k - 1, F.lit(0))), lambda later: later[key] == e[key]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e[key], e[value])))


def map_to_entries(m: Column, key: str = "key") -> Column:
    """A map as an array of its values with the key inlined, in order of keys."""
    return F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias(key), F.try_element_at(m, k).alias("value")))


def any_value(m: Column, test) -> Column:  # noqa: ANN001
    """Whether a map has a value that passes."""
    return F.exists(F.map_values(m), test)


def texts_of(json: Column) -> Column:
    """The items of a JSON array as texts; none if the JSON is something else."""
    return F.coalesce(F.when(F.trim(json).startswith("["), F.from_json(json, "array<string>")), F.lit([]).cast("array<string>"))


def keep_members(obj: Column, names: list[str]) -> Column:
    """A flat JSON object with only the named members that it has, in this order."""
    kept = F.map_filter(F.from_json(obj, "map<string,string>"), lambda k, v: k.isin(*names) & v.isNotNull())
    return F.to_json(F.map_from_entries(F.filter(F.transform(F.lit(names), lambda n: F.struct(n, F.try_element_at(kept, n).alias("v"))), lambda e: e["v"].isNotNull())))


def merge_objects(first: Column, second: Column) -> Column:
    """Two flat JSON objects as one; members of the second win."""
    a, b = (F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")) for c in (first, second))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def box_of(points: Column) -> Column:
    """(x0, y0, x1, y1) around points (x, y), rounded half to even; null for none."""
    side = lambda f, k: F.bround(f(F.transform(points, lambda p: p[k]))).cast("int")
    return F.when(F.size(points) > 0, F.struct(side(F.array_min, 0).alias("x0"), side(F.array_min, 1).alias("y0"), side(F.array_max, 0).alias("x1"), side(F.array_max, 1).alias("y1")))


def box_union(boxes: Column) -> Column:
    """The box around boxes; null ones don't count; null for none."""
    known = F.filter(boxes, lambda b: b.isNotNull())
    side = lambda f, name: f(F.transform(known, lambda b: b[name])).alias(name)
    return F.when(F.size(known) > 0, F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1")))


def box_contains(outer: Column, inner: Column) -> Column:
    """Whether a box holds another; false if either is null."""
    inside = reduce(lambda a, b: a & b, [outer["x0"] <= inner["x0"], outer["y0"] <= inner["y0"], outer["x1"] >= inner["x1"], outer["y1"] >= inner["y1"]])
    return F.coalesce(inside, F.lit(False))
