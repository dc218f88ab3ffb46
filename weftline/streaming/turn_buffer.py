"""Conversations whose turns arrive out of order: turns are held in the state store until those before them have come.

A conversation's state is a map of its turns and the time at which it is given up. When all the turns that the sender has announced are
there, the conversation comes out with its messages in order, and its state is dropped. If turns are missing when WAIT has passed since its
latest arrival (in event time, so that a replay gives the same), the timer puts out the messages before the first gap, marked as not
complete. Turns that come after that are a conversation anew. A turn that comes twice counts once, as it came last; null ids and turns
below 0 or beyond the announced number are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds after a conversation's latest turn.
WAIT = 10 * 60 * 1000
OUT = "conv_id long, complete boolean, messages array<struct<role: string, content: string>>"


class Turns(StatefulProcessor):
    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, content string")
        self.about = handle.getValueState("about", "n_turns long, ends long")

    def _out(self, key, complete: bool) -> pd.DataFrame:
        held = {k[0]: v for k, v in self.turns.iterator()}
        messages, at = [], 0
        while at in held:
            messages.append({"role": held[at][0], "content": held[at][1]})
            at += 1
        self.turns.clear()
        self.about.clear()
        return pd.DataFrame({"conv_id": [key[0]], "complete": [complete], "messages": [messages]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, ends = self.about.get() if self.about.exists() else (0, -1)
        new, latest = pd.concat(list(rows)).sort_values("at", kind="stable"), ends - self.wait  # a conversation's turns in a batch
        for turn, role, text, announced, at in zip(new["turn"].tolist(), new["role"].tolist(), new["text"].tolist(), new["n_turns"].tolist(), new["at"].tolist(), strict=True):
            n, latest = int(announced), max(latest, int(pd.Timestamp(at).timestamp() * 1000))
            self.turns.updateValue((int(turn),), (role, text))
        if ends >= 0:
            self.handle.deleteTimer(ends)
        if sum(1 for k in self.turns.keys() if k[0] < n) >= n:  # noqa: SIM118
            yield self._out(key, True)
        else:
            self.about.update((n, latest + self.wait))
            self.handle.registerTimer(latest + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.about.exists():
            yield self._out(key, False)

    def close(self) -> None:
        pass


def ordered_conversations(turns: DataFrame, wait: int = WAIT, late: str = "1 hour") -> DataFrame:
    """turns: a stream of conv_id, turn, role, text, n_turns (announced), at (when it came). conv_id, complete and messages of each
    conversation that is whole or given up."""
    usable = turns.filter("conv_id is not null and turn >= 0 and turn < n_turns and at is not null")
    own = usable.select("conv_id", "turn", "role", "text", F.col("n_turns").cast("long").alias("n_turns"), "at").withWatermark("at", late)
    return own.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Turns(wait), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
