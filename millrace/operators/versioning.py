"""Slowly changing versions, retirement, upserts and replay of operation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scd2_publish(current: DataFrame, batch: DataFrame, key: str, fields: list[str], today: Column) -> DataFrame:
    """The version table after a batch: changed and missing keys' versions are closed today, changed and new keys' opened.

    ``current`` has key, fields, valid_from and valid_until (null: open). One full join serves all three cases.
    """
    live, past = current.filter("valid_until is null"), current.filter("valid_until is not null")
    a = live.select(key, F.struct(*fields, "valid_from").alias("a"))
    b = batch.select(key, F.struct(*fields).alias("b"))
    same = F.col("a").isNotNull() & F.col("b").isNotNull()
    for f in fields:
        same = same & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    met = a.join(b, key, "full").withColumn("_same", same)
    version = lambda side, since, until: F.struct(*[F.col(f"{side}.{f}").alias(f) for f in fields], since.alias("valid_from"), until.alias("valid_until"))
    none = F.lit(None).cast("date")
    old = F.when(F.col("a").isNotNull(), version("a", F.col("a.valid_from"), F.when(F.col("_same"), none).otherwise(today)))
    new = F.when(F.col("b").isNotNull() & ~F.col("_same"), version("b", today, none))
    rows = met.select(key, F.explode(F.array_compact(F.array(old, new))).alias("v")).select(key, "v.*")
    return past.select(*rows.columns).union(rows)


def retire_missing(current: DataFrame, batch: DataFrame, key: str, flag: str = "is_current") -> DataFrame:
    """``current`` with the flag off for keys that the batch lacks."""
    seen = batch.select(key).distinct().withColumn("_seen", F.lit(True))
    return current.join(seen, key, "left").withColumn(flag, F.col(flag) & F.coalesce("_seen", F.lit(False))).drop("_seen")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], position: Column) -> DataFrame:
    """``current`` with the batch's rows in place of rows of the same keys; the last of a key's batch rows wins."""
    row = F.struct(*[F.col(c) for c in current.columns])
    last = batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(row, position).alias("r")).select("r.*")
    return current.join(last.select(*keys), keys, "left_anti").select(*current.columns).union(last.select(*current.columns))


def fold_ops(ops: DataFrame, op_id: str, entity: str, kind: str, position: str, removes: str) -> DataFrame:
    """The state after an operation log: each op id applies once (its first row), the version counts applied ops, the last decides.

    (entity, version, last_op, removed). Ops are deduplicated and folded by aggregates alone.
    """
    once = ops.groupBy(op_id).agg(F.min_by(F.struct(entity, kind, position), position).alias("o")).select(op_id, "o.*")
    return once.groupBy(entity).agg(F.count(F.lit(1)).alias("version"), F.max_by(kind, position).alias("last_op"), (F.max_by(kind, position) == removes).alias("removed"))


def activate(versions: DataFrame, loaded: DataFrame, version: str, flag: str = "is_active") -> DataFrame:
    """Versions after a bulk load: the loaded one is added and is the only active one."""
    rest = versions.join(loaded.select(version).distinct(), version, "left_anti")
    return rest.withColumn(flag, F.lit(False)).unionByName(loaded.withColumn(flag, F.lit(True)).select(*rest.columns))


def insert_missing(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and the batch's rows of keys that it lacks (the batch's keys are distinct); existing rows stay as they are."""
    return current.unionByName(batch.join(current.select(*keys), keys, "left_anti").select(*current.columns))


def update_from(current: DataFrame, changes: DataFrame, keys: list[str], fields: list[str], position: str | None = None) -> DataFrame:
    """``current`` with the fields of matching changes where they aren't null.

    Of several changes of a key the last by ``position`` counts (without one, the greatest by its fields); rows of ``current`` never multiply.
    """
    last = F.max_by(F.struct(*fields), F.col(position)) if position else F.max(F.struct(*fields))
    new = changes.groupBy(*keys).agg(last.alias("_new"))
    joined = current.join(new, keys, "left")
    return joined.withColumns({f: F.coalesce(F.col("_new")[f], F.col(f)) for f in fields}).select(*current.columns)


def roll_back(current: DataFrame, today: Column, **wanted: object) -> DataFrame:
    """``current`` with the open versions that fit all given values closed; without a value it refuses to run."""
    given = {c: v for c, v in wanted.items() if v is not None}
    if not given:
        raise ValueError("a rollback needs a key")
    hit = F.col("valid_until").isNull()
    for c, v in given.items():
        hit = hit & F.col(c).eqNullSafe(F.lit(v))
    return current.withColumn("valid_until", F.when(hit, today).otherwise(F.col("valid_until")))


def prune(rows: DataFrame, old: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with ``deleted``): rows that aren't old, and how many are."""
    gone = F.coalesce(old, F.lit(False))
    return rows.filter(~gone), rows.agg(F.count_if(gone).alias("deleted"))


def gate(checks: DataFrame) -> DataFrame:
    """One row (passed, failures) from check rows of (check_name, failing): publication goes on only if nothing fails."""
    return checks.agg((F.coalesce(F.sum("failing"), F.lit(0)) == 0).alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("failing") > 0, F.col("check_name")))), ",").alias("failures"))


def merge_by_version(local: DataFrame, server: DataFrame, key: str, fields: list[str], keep: list[str]) -> DataFrame:
    """Local rows (key, version, pending, fields, keep) merged with the server's.

    A server row replaces the local one if its version is not less and nothing is pending; else the local row stays,
    and only its empty ``fields`` are filled from the server. Rows only one side has stay.
    """
    s = server.select(key, *[F.col(c).alias(f"_{c}") for c in ("version", *fields, *keep)])
    met = local.join(s, key, "full")
    replaces = F.col("_version").isNotNull() & (F.col("version").isNull() | ((F.col("_version") >= F.col("version")) & (F.coalesce("pending", F.lit(0)) == 0)))
    out = {c: F.when(replaces, F.col(f"_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"_{c}"))) for c in fields}
    out |= {c: F.when(replaces, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("version", *keep)}
    return met.withColumn("replaced", replaces).withColumns(out).select(key, "version", *fields, *keep, "replaced")


def replay(ops: DataFrame, op_id: str, entity: str, kind: str, value: str, position: str, sets: dict[str, tuple[str, Column, Column]], removes: str) -> DataFrame:
    """The entities after an operation log: (entity, version, removed, and a column for each of ``sets``).

    An op id applies once (its first row). ``sets`` maps a column to (kind of op, whether its value is valid, the value stored); the last valid op of that kind
    decides; an op with an invalid value isn't applied. After a removal nothing applies. Every applied op adds one to the version, which begins at 1.
    """
    once = ops.groupBy(op_id).agg(F.min_by(F.struct(entity, kind, value, position), position).alias("_o")).select("_o.*")
    ended = F.min(F.when(F.col(kind) == removes, F.col(position))).over(Window.partitionBy(entity))
    live = once.withColumn("_end", ended).filter(F.col("_end").isNull() | (F.col(position) <= F.col("_end")))
    valid = F.lit(True)
    for k, good, _ in sets.values():
        valid = valid & ((F.col(kind) != k) | F.coalesce(good, F.lit(False)))
    live = live.filter(valid)
    stored = [F.max_by(F.when(F.col(kind) == k, stored), F.when(F.col(kind) == k, F.col(position))).alias(c) for c, (k, _, stored) in sets.items()]
    return live.groupBy(entity).agg((F.count(F.lit(1)) + 1).alias("version"), F.max(F.col(kind) == removes).alias("removed"), *stored)


def shares(ops: DataFrame, owner: str, kind: str, position: str, day: Column, quota: int, create: str, rotate: str, revoke: str) -> DataFrame:
    """What each share operation did: created, reused, rotated, refused (the quota of rotations a local day is used up) or revoked.

    A create with an active share reuses it; a rotation revokes it and creates another. Operations of other kinds do nothing.
    """
    of = ops.filter(F.col(kind).isin(create, rotate, revoke)).withColumn("_day", day)
    nth = F.row_number().over(Window.partitionBy(owner, "_day", kind).orderBy(position))
    of = of.withColumn("_refused", (F.col(kind) == rotate) & (nth > quota))
    w = Window.partitionBy(owner).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    active = F.coalesce(F.last(F.when(~F.col("_refused"), F.col(kind) != revoke), True).over(w), F.lit(False))
    done = F.when(F.col("_refused"), "refused").when(F.col(kind) == revoke, F.when(active, "revoked").otherwise("nothing")).when(F.col(kind) == rotate, "rotated").otherwise(F.when(active, "reused").otherwise("created"))
    return of.withColumn("outcome", done).drop("_day", "_refused")


def get_or_create(wanted: DataFrame, existing: DataFrame, owner: str, updated: str, usable: Column, new_id: Column) -> DataFrame:
    """(owner, id, created): each owner's usable row of the latest update, else a new one."""
    live = existing.filter(usable).groupBy(owner).agg(F.max_by("id", F.struct(updated, "id")).alias("_id"))
    met = wanted.select(owner).distinct().join(live, owner, "left")
    return met.select(owner, F.coalesce("_id", new_id).alias("id"), F.col("_id").isNull().alias("created"))


def publish_parts(parts: dict[str, tuple[DataFrame, DataFrame]], key: str, live: str = "is_current") -> dict[str, DataFrame]:
    """Each named (current, batch) pair after publication: the batch's rows current, current rows it lacks retired, in the order given.

    It refuses to run where every batch is empty, which would retire everything.
    """
    if all(batch.limit(1).count() == 0 for _, batch in parts.values()):
        raise ValueError("nothing to publish")
    out = {}
    for name, (current, batch) in parts.items():
        rest = current.join(batch.select(key), key, "left_anti").withColumn(live, F.lit(False))
        out[name] = rest.unionByName(batch.withColumn(live, F.lit(True)))
    return out
