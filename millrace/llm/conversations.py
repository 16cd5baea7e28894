"""Conversation structure repair by the cheapest edits, as a fold of Spark SQL.

A conversation is sound if its roles' initials read ``(s?(ua)+)?``. Turns are kept (K, costs 0), given the other
role (R, costs 1: user or assistant, whichever is due), deleted (D, costs 2; blank and duplicate turns must be), and empty turns
are inserted (I, costs 5) anywhere; a truncated turn that stays costs 5 more. The cheapest edits win, and of equally
cheap ones those whose initials, in order, come first in ASCII.

Windows mark each turn's first fault. Then ``aggregate()`` folds sorted arrays of turns with four (cost, audit) structs, one for each
state of that pattern (nothing yet, after s, u or a), taking native ``least`` of what leads to a state. Costs follow from an audit's letters, and
so do the roles of R and I; therefore the order of two candidates of one state never changes by what follows, and the fold is exact.

Scale: an array holds ``block`` turns at most. A block is folded from each of the four states, and the blocks of a conversation are
folded by their 4 x 4 results in turn, so a conversation of any length passes through in bounded pieces; only its letters
(the result itself) meet in one row. Texts are hashed as a stream of blocks, as SHA-256 demands. One shuffle by conversation serves the
windows and both folds; the window sort spills to disk.

Edge cases: null roles and texts count as one space; null turns come first; turns of one number are taken by role, then text; null conv_ids
are one conversation; an empty role has no initial and can't be kept; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, materialize

SPACES = " \t\n\x0b\x0c\r"
INSERT, DELETE, TRUNCATED, REROLE = 5, 2, 5, 1
STATES = "esua"
_PATH = "struct<cost:bigint,audit:string>"


def damage(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the row, 4 makes its role user. Nulls are one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("_d <> 0").select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def faults(turns: DataFrame) -> DataFrame:
    """Turns in order: conv_id, turn, role, text, place (from 0), fault (blank, duplicate, truncated or null), illegal.

    ``illegal`` is true if the initials of the turn before and of this one are none of su, ua, au.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    rows = rows.withColumn("place", F.row_number().over(place) - 1).withColumn("before", F.lag(F.substring("role", 1, 1)).over(place))
    cut = F.rtrim("text", F.lit(SPACES))
    last = F.substring(cut, -1, 1)
    fault = F.when(cut == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    pair = F.concat("before", F.substring("role", 1, 1))
    return rows.select("conv_id", "turn", "role", "text", "place", fault.alias("fault"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))


def _plus(path: str, cost: str | int, letter: str) -> str:
    """A path with one more edit; null stays null. (The fold's parts are SQL expressions.)"""
    return f"if({path} is null, null, named_struct('cost', {path}.cost + {cost}, 'audit', concat({path}.audit, {letter})))"


def _let(name: str, value: str, use: str) -> str:
    """``use``, in which ``name`` stands for ``value``."""
    return f"transform(array({value}), {name} -> {use})[0]"


def _four(e: str, s: str, u: str, a: str) -> str:
    return f"named_struct('e', {e}, 's', {s}, 'u', {u}, 'a', {a})"


#: The four paths ``at`` when empty turns may be inserted here: a user after any state but u, an assistant after u.
INSERTED = _let("user", f"least(at.u, {_plus('least(at.e, at.s, at.a)', INSERT, repr('I'))})", _four("at.e", "at.s", "user", f"least(at.a, {_plus('user', INSERT, repr('I'))})"))


def _held(path: str, initial: str) -> str:
    """The path with the turn kept, or given the role of that initial."""
    same = f"turn.initial = '{initial}'"
    kept = _plus(path, f"if(turn.truncated, {TRUNCATED}, 0) + if({same}, 0, {REROLE})", f"if({same}, 'K', 'R')")
    return f"if(turn.goes{f' or not {same}' if initial == 's' else ''}, null, {kept})"


_gone = {k: _plus(f"now.{k}", DELETE, repr("D")) for k in STATES}
_least = {k: f"least({_gone[k]}, {_held(path, k)})" for k, path in (("s", "now.e"), ("u", "least(now.e, now.s, now.a)"), ("a", "now.u"))}
#: The four paths ``at`` after one ``turn``.
STEP = _let("now", INSERTED, _four(_gone["e"], **_least))
_nowhere = f"cast(null as {_PATH})"
#: Paths that begin in each of the states at no cost.
STARTS = [_four(**({k: _nowhere for k in STATES} | {k0: "named_struct('cost', 0L, 'audit', '')"})) for k0 in STATES]


def _joined(k: str, to: str) -> str:
    """The path to a state through a block entered in state ``k``; the state's letter in small marks the block's end."""
    more = f"block.paths[{STATES.index(k)}].{to}"
    return f"if(at.{k} is null or {more} is null, null, named_struct('cost', at.{k}.cost + {more}.cost, 'audit', concat(at.{k}.audit, {more}.audit, '{to}')))"


#: The four paths ``at`` after a ``block`` of turns.
THROUGH = _four(**{to: f"least({', '.join(_joined(k, to) for k in STATES)})" for to in STATES})


def _rows_of(block: Column, letters: Column, entry: Column) -> Column:
    """The repaired turns (edit, role, text) of a block, from its letters and the state before it."""
    edits = F.filter(F.split(letters, ""), lambda e: e != "")
    due = lambda state: F.when(state == "u", "assistant").otherwise("user")

    def put(acc: Column, letter: Column) -> Column:
        turn = F.get(block, acc["at"])
        role = F.when(letter == "K", turn["role"]).otherwise(due(acc["state"]))
        row = F.struct(letter.alias("edit"), role.alias("role"), F.when(letter == "I", "").otherwise(turn["text"]).alias("text"))
        return F.struct(
            (acc["at"] + F.when(letter == "I", 0).otherwise(1)).alias("at"),
            F.when(letter == "D", acc["state"]).otherwise(F.substring(role, 1, 1)).alias("state"),
            F.when(letter == "D", acc["rows"]).otherwise(F.concat(acc["rows"], F.array(row))).alias("rows"),
        )

    none = F.array().cast("array<struct<edit:string,role:string,text:string>>")
    zero = F.struct(F.lit(0).alias("at"), entry.alias("state"), none.alias("rows"))
    return F.aggregate(edits, zero, put, lambda acc: acc["rows"])


def repair(turns: DataFrame, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation of turns (conv_id, turn, role, text).

    Returns two tables. The first has a row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. The second
    has its repaired turns in blocks: conv_id, block, rows (array of edit, role, text).
    """
    marked = faults(turns).withColumn("block", F.floor(F.col("place") / block).cast("int"))
    fields = ("role", "text", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("goes"), (F.coalesce("fault", F.lit("")) == "truncated").alias("truncated"), F.substring("role", 1, 1).alias("initial"))
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    # Distinct turn numbers: turns are in order, so a number's first row is one whose predecessor has another.
    marked = marked.withColumn("new", F.coalesce(F.col("turn") != F.lag("turn").over(Window.partitionBy("conv_id").orderBy("place")), F.col("turn").isNotNull()))
    sums = (count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_if("new").alias("numbers"))
    held = marked.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", *fields))).alias("turns"), *sums)
    paths = F.expr(f"transform(array({', '.join(STARTS)}), start -> aggregate(turns, start, (at, turn) -> {STEP}))")
    held = materialize(held.withColumn("paths", paths), "conversation-blocks")
    totals = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "numbers")]
    whole = held.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "paths"))).alias("blocks"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *totals)

    best = F.expr(f"aggregate(blocks, {STARTS[0]}, (at, block) -> {THROUGH}, at -> least(at.e, {INSERTED}.a))")
    whole = whole.withColumn("best", best).drop("blocks")
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("numbers"), F.lit(0)).cast("bigint")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    summary = whole.select("conv_id", gaps.alias("gaps"), *counts, F.col("best.cost").alias("cost"), F.regexp_replace("best.audit", "[a-z]", "").alias("audit"))
    # A block's letters and the state before it; what is inserted after the last turn is a piece of its own.
    pieces = F.transform(F.regexp_extract_all("best.audit", F.lit("[A-Z]*[a-z]|[A-Z]+$"), F.lit(0)), lambda p, i: F.struct(i.alias("block"), F.regexp_replace(p, "[a-z]", "").alias("letters"), F.substring(p, -1, 1).alias("end")))
    by_block = whole.select("conv_id", F.inline(F.transform(pieces, lambda p: F.struct(p["block"].alias("block"), p["letters"].alias("letters"), F.when(p["block"] == 0, "e").otherwise(F.get(pieces, p["block"] - 1)["end"]).alias("entry")))))
    texts = held.select("conv_id", "block", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    both = by_block.alias("p").join(texts.alias("t"), F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("p.block") == F.col("t.block")), "left")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = both.select(F.col("p.conv_id").alias("conv_id"), F.col("p.block").alias("block"), _rows_of(F.coalesce("t.turns", empty), F.col("p.letters"), F.col("p.entry")).alias("rows"))
    return summary, rows


def text_digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, joined by newlines, of the blocks of :func:`repair`.

    A task reads its conversations block by block and holds one hash state. Conversations without lines are absent.
    """
    lines = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["role"], r["text"])), "\n")
    bodies = rows.filter(F.size("rows") > 0).select("conv_id", "block", lines.alias("body"))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sha = None, None
        for b in batches:
            names, out, done = b.column("conv_id"), [], []
            for k, body in zip(names, b.column("body"), strict=True):
                if sha is not None and k.equals(open_):
                    sha.update(b"\n")
                else:
                    if sha is not None:
                        done.append(open_.as_py()), out.append(sha.hexdigest())
                    open_, sha = k, hashlib.sha256()
                sha.update(body.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, names.type), pa.array(out, pa.string())], ["conv_id", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_.as_py()], open_.type), pa.array([sha.hexdigest()])], ["conv_id", "sha"])

    bound_batches(bodies)
    return bodies.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(digest, f"conv_id {kind}, sha string")
