"""Streams of edits that don't commute: the state of a key is its log, in keyed state that grows by what arrives.

Edits are in order of (ts, event_id), whatever the order of arrival. The state of a key holds the value now, a snapshot
of it some edits ago, the edits since then (tail), and the edits before it (past). Edits that come in order are applied
to the value now, and the work of a batch follows its edits; an edit that is late within the tail replays from the
snapshot, an older one from the beginning (then past is read, and only then). After SNAPSHOT edits the tail joins past.

With a watermark, edits up to it can't be preceded by new ones: an event-time timer of the key folds them into its
beginning and forgets them, so that state holds no more than the value and the edits after the watermark. That is an
option, since an edit behind the watermark is dropped.

Defined results: a late edit gives the value that all edits in order give; rows of equal (ts, event_id) are edits each,
in order of what they do; an edit without a place does nothing; keys without a row in the table of beginnings have no
state. ``apply`` says what an edit does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SNAPSHOT = 256
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: ts (microseconds), event_id, where, what
Edit = tuple[int, int, int | None, Any]

VALUE = "value string, ts long, event_id long, n_tail long"
START = "value string"
MARK = "value string, ts long, event_id long"
EDITS = "ts long, event_id long, first long, second string"


class Log(StatefulProcessor):
    """``apply``: value and edit to value. ``compact``: fold what is behind the watermark."""

    def __init__(self, apply: Callable[[str, Edit], str], *, compact: bool = False, snapshot: int = SNAPSHOT):
        self._apply, self._compact, self._every = apply, compact, snapshot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._start = handle.getValueState("start", START)
        self._mark = handle.getValueState("mark", MARK)
        self._now = handle.getValueState("now", VALUE)
        self._tail = handle.getListState("tail", EDITS)
        self._past = handle.getListState("past", EDITS)

    def close(self) -> None:
        pass

    def _fold(self, value: str, edits: list[Edit]) -> str:
        for edit in edits:
            value = self._apply(value, edit)
        return value

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[Edit] = []
        base = None
        for batch in rows:
            base = batch["base"].iloc[0] if base is None else base
            for ts, event, first, second in zip(batch["ts"], batch["event_id"], batch["first"], batch["second"]):
                new.append((int(ts), int(event), None if pd.isna(first) else int(first), None if second is None or second != second else second))
        new.sort(key=_order)
        if self._now.exists():
            value = self._later(new, *self._now.get())
        else:
            value = self._fold(base, new)
            self._start.update((base,))
            self._mark.update((base, *_NEVER))
            self._keep(new, value, new[-1][:2], len(new), append=False)
        if self._compact:
            self._handle.registerTimer(-(-new[-1][0] // 1000))
        yield pd.DataFrame({"key": [key[0]], "result": [value]})

    def _keep(self, tail: list[Edit], value: str, last: tuple[int, int], n: int, *, append: bool) -> None:
        """``tail``: the edits that it gains, or all of it."""
        if n < self._every:
            (self._tail.appendList if append else self._tail.put)(tail)
        else:
            whole = [*map(tuple, self._tail.get()), *tail] if append else tail
            self._past.appendList(whole)
            self._tail.clear()
            self._mark.update((value, *last))
            n = 0
        self._now.update((value, *last, n))

    def _later(self, new: list[Edit], value: str, ts: int, event: int, n: int) -> str:
        if new[0][:2] > (ts, event):
            value = self._fold(value, new)
            self._keep(new, value, new[-1][:2], n + len(new), append=True)
            return value
        start, *mark = self._mark.get()
        tail = sorted([*map(tuple, self._tail.get()), *new], key=_order)
        if tail[0][:2] <= tuple(mark):
            tail = sorted([*map(tuple, self._past.get()), *tail], key=_order)
            start = self._start.get()[0]
            self._past.clear()
            self._mark.update((start, *_NEVER))
        value = self._fold(start, tail)
        self._keep(tail, value, tail[-1][:2], len(tail), append=False)
        return value

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Edits up to the watermark become part of the beginning; nothing is returned, as the value stays."""
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        edits = sorted([*map(tuple, self._past.get()), *map(tuple, self._tail.get())], key=_order)
        kept = [e for e in edits if e[0] > upto]
        gone = edits[: len(edits) - len(kept)]
        if gone:
            start = self._fold(self._start.get()[0], gone)
            self._start.update((start,))
            self._mark.update((start, *gone[-1][:2]))
            self._past.clear()
            value, ts, event, _ = self._now.get()
            if kept:
                self._tail.put(kept)
            else:
                self._tail.clear()
            self._now.update((value, ts, event, len(kept)))
        return iter(())


_NEVER = (-(1 << 62), 0)


def _order(edit: Edit) -> tuple:
    return (*edit[:2], edit[2] is not None, edit[2] or 0, edit[3] or "")


def insert_one(text: str, edit: Edit) -> str:
    """``edit``: .., an offset, and what is inserted there."""
    _, _, offset, new = edit
    if offset is None:
        return text
    at = max(0, min(offset, len(text)))
    return text[:at] + (new or "") + text[at:]


def move_one(slots: str, edit: Edit) -> str:
    """``slots`` is a JSON array; a move that is null, or from or to a place that isn't there, does nothing."""
    _, _, start, to = edit
    values = json.loads(slots)
    if start is None or to is None or not (0 <= start < len(values) and 0 <= int(to) < len(values)):
        return slots
    values.insert(int(to), values.pop(start))
    return json.dumps(values)


def logged(edits: DataFrame, apply: Callable[[str, Edit], str], *, compact: bool = False, snapshot: int = SNAPSHOT) -> DataFrame:
    """key, result after each batch. ``edits``: key, base, ts (microseconds), event_id, first, second."""
    conf = edits.sparkSession.conf
    if conf.get(PROVIDER, "") != ROCKS:
        conf.set(PROVIDER, ROCKS)  # the state store that keeps lists and timers
    out = T.StructType([T.StructField("key", edits.schema["key"].dataType), T.StructField("result", T.StringType())])
    return edits.groupBy("key").transformWithStateInPandas(
        Log(apply, compact=compact, snapshot=snapshot),
        outputStructType=out,
        outputMode="update",
        timeMode="eventTime" if compact else "none",
    )
