"""Lifecycle pairing over a stream of log events.

The batch operator defines the result: a closer takes the latest open task of its process and entry. Open
tasks are the state of a process; a closed task is emitted when its closer arrives, and what is still open
when the process has been silent for the timeout is emitted as open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUT = "process_id string, what string, seq long, entry_point string, start_ms long, end_seq long, end_ms long"
#: Per process: open tasks as parallel arrays.
STATE = "seqs array<long>, entries array<string>, starts array<long>"


def pair_stream(events: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """Closed tasks as they close, and open ones when a process has been silent for the timeout.

    events: process_id, seq, kind (1 opens, -1 closes), entry_point, ms. Events of a process must arrive in
    order of seq across batches; within a batch they are sorted.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["process_id", "what", "seq", "entry_point", "start_ms", "end_seq", "end_ms"]
        seqs, entries, starts = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows: list[tuple] = []
        if state.hasTimedOut:
            rows = [(key[0], "open", s, e, b, None, None) for s, e, b in zip(seqs, entries, starts)]
            state.remove()
        else:
            for r in pd.concat(list(parts)).sort_values("seq").itertuples(index=False):
                if r.kind == 1:
                    seqs.append(r.seq)
                    entries.append(r.entry_point)
                    starts.append(r.ms)
                    continue
                held = next((i for i in range(len(seqs) - 1, -1, -1) if entries[i] == r.entry_point), None)
                if held is not None:
                    rows.append((key[0], "closed", seqs.pop(held), entries.pop(held), starts.pop(held), r.seq, r.ms))
            state.update((seqs, entries, starts))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=columns).astype({"seq": "Int64", "start_ms": "Int64", "end_seq": "Int64", "end_ms": "Int64"})

    return events.groupBy("process_id").applyInPandasWithState(step, OUT, STATE, "append", "ProcessingTimeTimeout")
