"""Nested snapshots of read documents: quality, regions by layout, provenance of fields, authority of sources. All of it is native Columns over one row.

A null array counts as an empty one, a null status or engine as ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import errors

# Fixed values.
LEAST_WIDTH, LEAST_HEIGHT = 800, 800
REPORTED = "^(ocr_config_error|ocr_engine_unavailable|ocr_engine_error|region_segmentation_error):"


def _size(items: Column) -> Column:
    return F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0)).cast("long")


def counted(keys: Column) -> Column:
    """``key=count`` of an array's values in order of keys, comma-joined."""
    each = F.transform(F.array_sort(F.array_distinct(keys)), lambda k: F.concat_ws("=", k, F.size(F.filter(keys, lambda x: x == k)).cast("string")))
    return F.array_join(each, ",")


def last_by_key(pairs: Column) -> Column:
    """``key=value`` of an array of structs (key, value), the last of each key, in order of keys, comma-joined."""
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, last(k).cast("string"))), ",")


def quality(rows: DataFrame, row_id: str, least: tuple[int, int] = (LEAST_WIDTH, LEAST_HEIGHT)) -> DataFrame:
    """(id, pages, regions, tokens, statuses, engine_tokens, reviewable, findings) of snapshots.

    Rows hold ``pages`` (structs ``number, hash, width, height``), ``runs`` (``engine, status, tokens``, the latter a number), ``regions``, ``tokens`` and ``errors`` (arrays of texts).
    Findings stand in the order in which they are found, each once.
    """
    pages, runs = F.coalesce("pages", F.array().cast(rows.schema["pages"].dataType)), F.coalesce("runs", F.array().cast(rows.schema["runs"].dataType))
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    fits = lambda p: (F.coalesce(p["width"], F.lit(0)) >= least[0]) & (F.coalesce(p["height"], F.lit(0)) >= least[1])
    of_page = lambda p: F.transform(errors(("missing_page_image_hash", F.coalesce(p["hash"], F.lit("")) == ""), ("low_quality_image", ~fits(p))), lambda x: F.concat(x, F.lit(":page_"), F.coalesce(p["number"], F.lit(0)).cast("string")))
    read = F.exists(runs, lambda r: F.coalesce(r["tokens"], F.lit(0)) > 0)
    first = errors(("missing_source_pages", F.size(pages) == 0), ("missing_regions", _size(F.col("regions")) == 0), ("missing_ocr_tokens", (_size(F.col("tokens")) == 0) & ~read))
    told = F.filter(F.coalesce("errors", F.lit([]).cast("array<string>")), lambda x: x.rlike(REPORTED))
    found = F.array_distinct(F.concat(first, told, F.flatten(F.transform(pages, of_page))))
    engines = F.transform(runs, lambda r: F.struct(name(r["engine"]).alias("key"), F.coalesce(r["tokens"], F.lit(0)).alias("value")))
    return rows.select(
        F.col(row_id).alias("id"), _size(pages).alias("pages"), _size(F.col("regions")).alias("regions"), _size(F.col("tokens")).alias("tokens"), counted(F.transform(runs, lambda r: name(r["status"]))).alias("statuses"),
        last_by_key(engines).alias("engine_tokens"), _size(F.filter(pages, fits)).alias("reviewable"), F.array_join(found, ",").alias("findings"),
    )


def regions(rows: DataFrame, row_id: str, family: str, width: str, height: str, layouts: dict[str, list[tuple[str, float, float, float, float]]]) -> DataFrame:
    """(id, nth, region, left, top, right, bottom): the regions of each row's layout in pixels, rounded to even and held inside the page; a family without a layout is one ``unknown`` region.

    Null sizes are 0.
    """
    w, h = (F.coalesce(F.col(c), F.lit(0)) for c in (width, height))
    spot = lambda side, part: F.greatest(F.lit(0), F.least(side, F.bround(side * F.lit(float(part)), 0).cast("long")))
    boxes = lambda layout: F.array(*[F.struct(F.lit(n).alias("nth"), F.lit(name).alias("region"), spot(w, a).alias("left"), spot(h, b).alias("top"), spot(w, c).alias("right"), spot(h, d).alias("bottom")) for n, (name, a, b, c, d) in enumerate(layout, 1)])
    chosen = boxes([("unknown", 0, 0, 1, 1)])
    for name, layout in layouts.items():
        chosen = F.when(F.col(family) == name, boxes(layout)).otherwise(chosen)
    return rows.select(F.col(row_id).alias("id"), F.inline(chosen))


def any_value(m: Column, test) -> Column:  # noqa: ANN001
    """Whether an entry of a map has a value that passes; null maps have none, and a test that is null does not pass."""
    return F.coalesce(F.exists(F.map_values(m), lambda v: F.coalesce(test(v), F.lit(False))), F.lit(False))


def disagrees(agreements: Column, fine: tuple[str, ...]) -> Column:
    """Whether any field's agreement is told and not a fine one."""
    return any_value(agreements, lambda v: (v != "") & ~v.isin(*fine))


def provenance_errors(rows: DataFrame, key: str, required: list[str], prefix: str) -> DataFrame:
    """(key, error) of rows ``key, source_url, source_sha256, price_state, spans`` (map of field to an array of texts).

    A row needs a source url, a digest of 64 hexadecimal digits, spans for its join and each required field, and for its price if that is free or paid; any other told price has
    no source at all. Errors begin with ``prefix``.
    """
    spans = lambda f: F.coalesce(F.size(F.try_element_at("spans", F.lit(f))) > 0, F.lit(False))
    state = F.coalesce(F.nullif("price_state", F.lit("")), F.lit("unknown"))
    codes = errors(
        ("missing_source_url", F.coalesce("source_url", F.lit("")) == ""), ("missing_source_hash", ~F.coalesce(F.col("source_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))), ("missing_resort_join", ~spans("resort_join")),
        *[(f"missing_{f}_provenance", ~spans(f)) for f in required], ("price_without_source", (state != "unknown") & ~(state.isin("free", "fee") & spans("price"))),
    )
    return rows.select(key, F.explode(F.transform(codes, lambda x: F.concat(F.lit(prefix), x))).alias("error"))


def authority(kind: Column, policy: list[dict]) -> Column:
    """(authority, may_price, may_override) of a kind of source by the first policy row (``kind, authority, forbidden, cannot_override``) of its kind; an unknown kind may nothing."""
    out = F.struct(F.lit("unknown").alias("authority"), F.lit(False).alias("may_price"), F.lit(False).alias("may_override"))
    for row in reversed(policy):
        price = not {"public_price_state", "public_price_amount"} & set(row.get("forbidden", ()))
        over = "free_price_state" not in row.get("cannot_override", ())
        out = F.when(kind == row["kind"], F.struct(F.lit(row.get("authority", "")).alias("authority"), F.lit(price).alias("may_price"), F.lit(over).alias("may_override"))).otherwise(out)
    return out


def windows(rows: DataFrame, location: str, start: str, storm: Column, rain: Column, heat: Column, hour: Column) -> DataFrame:
    """(window, start, action, chapter, avoid) of windows in order of their start (ties: none may occur in a location): the window's name holds its place among its location's, counted from 0."""
    high = lambda c: F.coalesce(c == "high", F.lit(False))
    place = F.row_number().over(Window.partitionBy(location).orderBy(start)) - 1
    action = F.when(high(storm), "stay_indoors").when(high(rain) | high(heat), "bring_backup").otherwise("go_now")
    chapter = F.when(high(storm), "Storm Mode").when(high(rain), "Rain Window").when(high(heat), "Heat Buildup").when(hour >= 18, "Starlight Reset").otherwise("Sunshine Start")
    avoid = F.when(high(storm), "pool,campfire,outdoor_movie").when(high(heat), "walking_heavy,heat_sensitive").otherwise("")
    name = F.concat_ws("-", F.col(location).cast("string"), place.cast("string"), F.date_format(start, "yyyyMMddHHmmss"))
    return rows.select(name.alias("window"), start, action.alias("action"), chapter.alias("chapter"), avoid.alias("avoid"))
