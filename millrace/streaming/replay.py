"""The ordered replay of :mod:`millrace.operators.replay` as a stream: keyed state with event-time timers.

Operations wait in their owner's state until the watermark has passed them, and are then carried out in order; a timer wakes owners whose
operations have become ready or too old. So the results are those of the batch form over all operations before the watermark, whatever
the order or the batches in which they come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.replay import RESULTS, Rules, apply, as_frame, as_op, empty_plan, expire, prepared


def replay_stream(ops: DataFrame, late: str, rules: Rules | None = None) -> DataFrame:
    """Results of a stream of operations, as :func:`millrace.operators.replay.replay` gives them; operations later than ``late`` are left out."""
    rules = rules or Rules()
    own = prepared(ops.withWatermark("at", late))
    kind = own.schema["owner"].dataType.simpleString()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        plan, held = json.loads(state.get[0]) if state.exists else [empty_plan(), []]
        for frame in frames:
            held += [as_op(r.op_id, r.kind, r.item, r.note, r.us, r.seq) for r in frame.itertuples(index=False)]
        now = state.getCurrentWatermarkMs() * 1000
        held.sort(key=lambda o: (o["at"], o["seq"], o["op_id"]))
        ready = [o for o in held if o["at"] < now]
        held = held[len(ready) :]
        results = [r for o in ready for r in apply(plan, o, rules)] + expire(plan, now, rules)
        state.update((json.dumps([plan, held]),))
        wakes = [o["at"] + 1000 for o in held[:1]] + [o["at"] + rules.give_up * 1_000_000 + 1000 for o in plan["pending"][:1]]
        if wakes:
            state.setTimeoutTimestamp(max(min(wakes), now + 1000) // 1000)
        if results:
            yield as_frame([(key[0], *r) for r in results])

    return own.groupBy("owner").applyInPandasWithState(run, f"owner {kind}, {RESULTS}", "s string", "append", GroupStateTimeout.EventTimeTimeout)
