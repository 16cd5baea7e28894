"""Ordered replay of operations of which some fail: a failed one stays pending in its place, a repeated one gets its first result.

Operations have owner, op_id, kind (add, remove or note), item, note, at (a timestamp) and seq (order among equal times). Each owner has a plan of
at most ``most`` items. An addition fails while the plan is full, a removal or a note while the item isn't there. Whenever an operation
changes a plan, its pending operations are tried again, once each, in order. Pending operations expire ``give_up`` seconds after their time; ledger entries
of decided ones are kept for ``remember`` seconds.

:func:`replay` is the batch form: owners' operations stream through tasks in order, so a task holds one plan, its pending operations and its ledger, however long
the log. :mod:`millrace.streaming.replay` has the same fold as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULTS = "op_id bigint, result string, repeated boolean, decided timestamp_ntz, version bigint, waiting bigint"


@dataclass(frozen=True)
class Rules:
    most: int = 5
    give_up: int = 86_400
    remember: int = 7 * 86_400


def empty_plan() -> dict:
    return {"items": {}, "version": 0, "pending": [], "ledger": {}}


def _changes(plan: dict, op: dict, rules: Rules) -> bool:
    """Carry out an operation if it can be; whether it was."""
    items, item = plan["items"], str(op["item"])
    if op["kind"] == "add" and (item in items or len(items) < rules.most):
        items[item] = op["note"]
    elif op["kind"] == "note" and item in items:
        items[item] = op["note"]
    elif op["kind"] == "remove" and item in items:
        del items[item]
    else:
        return False
    plan["version"] += 1
    return True


def expire(plan: dict, now: int, rules: Rules) -> list[tuple]:
    """Results of the pending operations that are too old at ``now`` (microseconds), which go; old ledger entries go, too."""
    out, kept = [], []
    for op in plan["pending"]:
        until = op["at"] + rules.give_up * 1_000_000
        if until < now:
            plan["ledger"][str(op["op_id"])] = ["expired", until]
            out.append((op["op_id"], "expired", False, until, plan["version"]))
        else:
            kept.append(op)
    plan["pending"] = kept
    plan["ledger"] = {k: v for k, v in plan["ledger"].items() if v[1] + rules.remember * 1_000_000 >= now}
    return [(*r, len(kept)) for r in out]


def apply(plan: dict, op: dict, rules: Rules) -> list[tuple]:
    """Results (op_id, result, repeated, decided, version, waiting) of the next operation in order and of what it sets free; changes ``plan``."""
    now, out = op["at"], expire(plan, op["at"], rules)
    known = plan["ledger"].get(str(op["op_id"]))
    waits = any(p["op_id"] == op["op_id"] for p in plan["pending"])
    if known or waits:
        return [*out, (op["op_id"], known[0] if known else "pending", True, now, plan["version"], len(plan["pending"]))]
    if not _changes(plan, op, rules):
        plan["pending"].append(op)
        return [*out, (op["op_id"], "pending", False, now, plan["version"], len(plan["pending"]))]
    done, left = [op], []
    versions = [plan["version"]]
    for p in plan["pending"]:
        if _changes(plan, p, rules):
            done.append(p)
            versions.append(plan["version"])
        else:
            left.append(p)
    plan["pending"] = left
    for d in done:
        plan["ledger"][str(d["op_id"])] = ["applied", now]
    return [*out, *((d["op_id"], "applied", False, now, v, len(left)) for d, v in zip(done, versions, strict=True))]


def as_op(op_id: int, kind: str, item: int, note: str | None, at: int, seq: int) -> dict:
    return {"op_id": int(op_id), "kind": kind, "item": int(item), "note": note, "at": int(at), "seq": int(seq)}


def as_frame(results: list[tuple]) -> pd.DataFrame:
    """A frame of results, each after its owner."""
    out = pd.DataFrame(results, columns=["owner", "op_id", "result", "repeated", "decided", "version", "waiting"])
    out["decided"] = pd.to_datetime(out["decided"], unit="us")
    return out


def prepared(ops: DataFrame) -> DataFrame:
    """Operations with their times in microseconds, too."""
    return ops.select("owner", "op_id", "kind", "item", "note", "at", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at").cast("timestamp_ntz")).alias("us"), "seq")


def replay(ops: DataFrame, rules: Rules | None = None, until: Column | None = None) -> DataFrame:
    """(owner, op_id, result, repeated, decided, version, waiting): what became of every operation before ``until``, in the order of decisions.

    ``result`` is applied, pending or expired; an operation that was pending first has a row for that and one for its end. Without
    ``until`` all operations count, and only those expire that a later one of their owner has outlived.
    """
    rules = rules or Rules()
    own = prepared(ops)
    limit = F.lit(None).cast("bigint") if until is None else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), until)
    own = own.withColumn("until", limit).filter(F.col("until").isNull() | (F.col("us") < F.col("until")))
    kind = own.schema["owner"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, plan, end = None, None, None

        def rest() -> list[tuple]:
            return [(owner, *r) for r in expire(plan, end, rules)] if plan is not None and end is not None else []

        for frame in frames:
            out: list[tuple] = []
            for r in frame.itertuples(index=False):
                if plan is None or r.owner != owner:
                    out += rest()
                    owner, plan, end = r.owner, empty_plan(), None if pd.isna(r.until) else int(r.until)
                out += [(owner, *x) for x in apply(plan, as_op(r.op_id, r.kind, r.item, r.note, r.us, r.seq), rules)]
            yield as_frame(out)
        yield as_frame(rest())

    dealt = own.filter("owner is not null").repartition("owner").sortWithinPartitions("owner", "us", "seq", "op_id")
    return dealt.mapInPandas(run, f"owner {kind}, {RESULTS}")
