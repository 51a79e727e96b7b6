"""Stateful processors with several kinds of state per key, and timers that let state go.

Rows of a key must come in order across micro-batches; inside one they are sorted here. A row that
comes late is an error, as nothing after it could be right. A key that is silent for ``IDLE_MS`` loses its
state, so the state follows the runs under way and not all there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalweave.operators.audit import COMPONENTS

#: How long a key may be silent before its state goes (milliseconds of processing time).
IDLE_MS = 6 * 60 * 60 * 1000


class Ordered(StatefulProcessor):
    """Common part: rows sorted by ``order``, the last place seen per key, and the idle timer."""

    order: tuple[str, ...]

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", ", ".join(f"at{i} bigint" for i in range(len(self.order))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(list(self.order), kind="stable").reset_index(drop=True)
        first, end = (tuple(int(frame[c].iloc[n]) for c in self.order) for n in (0, -1))
        held = self.last.get() if self.last.exists() else None
        if held is not None and first <= tuple(held):
            late, seen = ("/".join(map(str, at)) for at in (first, held))
            raise ValueError(f"{'/'.join(map(str, key))}: step {late} came after step {seen}")
        self.last.update(end)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self.rows(key, frame)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from self.gone(key)

    def rows(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def gone(self, key) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def close(self) -> None:
        pass


ROUTE_KEYS = ["run_id", "layer_index"]
ROUTE_OVERLAP = (
    "run_id string, canvas_index int, layer_index int, token_index int, global_step int, "
    "event_order int, k int, before_global_step int, before_event_order int, before_k int, overlap double"
)
_ROUTES = "tokens array<int>, steps array<int>, orders array<int>, sizes array<int>, experts array<int>"


def _padded(lists: list, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of one matrix, and their lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.full((len(lists), int(sizes.max(initial=0))), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(x, np.int64) for x in lists] or [[]])
    return out, sizes


class RouteOverlap(Ordered):
    """Per (run, layer): how far a token's experts are those of the token's event before.

    The state maps a canvas to the last routes of its tokens, one packed entry. Only the canvas under
    way is kept: when a later one starts, the entry of the one before goes. A token's experts are distinct.
    """

    order = ("global_step", "event_order")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.routes = handle.getMapState("routes", "canvas_index int", _ROUTES)

    def rows(self, key, frame):
        frame = frame.sort_values(["canvas_index", *self.order, "token_index"], kind="stable")
        canvases = frame["canvas_index"].to_numpy()
        now = int(canvases.max())
        out = []
        for canvas in np.unique(canvases).tolist():
            held = self.routes.getValue((canvas,)) if self.routes.containsKey((canvas,)) else None
            made, kept = self._looked_back(frame[canvases == canvas], held)
            out.append(made.assign(run_id=key[0], layer_index=key[1], canvas_index=canvas))
            if canvas == now:
                self.routes.updateValue((canvas,), kept)
        for (canvas,) in list(self.routes.keys()):
            if canvas < now:
                self.routes.removeKey((canvas,))
        names = [f.split()[0] for f in ROUTE_OVERLAP.split(", ")]
        whole = dict.fromkeys(("before_global_step", "before_event_order", "before_k"), "Int32")
        yield pd.concat(out)[names].astype(whole | {"overlap": "Float64"})

    def gone(self, key):
        self.routes.clear()
        yield pd.DataFrame()

    @staticmethod
    def _looked_back(frame: pd.DataFrame, held) -> tuple[pd.DataFrame, tuple]:
        """The overlaps of one canvas' rows, and the last route of each of its tokens."""
        token, step, order = (frame[c].to_numpy(np.int64) for c in ("token_index", "global_step", "event_order"))
        experts = frame["expert_ids"].tolist()
        old = 0
        if held is not None:
            tokens, steps, orders, sizes, flat = (np.asarray(x, np.int64) for x in held)
            old = len(tokens)
            token, step, order = (np.concatenate(x) for x in ((tokens, token), (steps, step), (orders, order)))
            experts = [*np.split(flat, np.cumsum(sizes)[:-1]), *experts]
        matrix, k = _padded(experts, -1)
        place = np.lexsort((order, step, token))
        same = np.append(False, token[place[1:]] == token[place[:-1]])
        before = np.full(len(token), -1)
        before[place[same]] = place[:-1][same[1:]]
        rows = np.arange(old, len(token))
        back = before[rows]
        there = back >= 0
        past = matrix[back]
        shared = ((matrix[rows][:, :, None] == past[:, None, :]) & (past[:, None, :] >= 0)).any(axis=2).sum(axis=1)
        pooled = np.maximum(k[rows] + k[back] - shared, 1)

        def where(values: np.ndarray) -> pd.Series:
            return pd.Series(np.where(there, values, np.nan))

        made = pd.DataFrame({"token_index": token[rows], "global_step": step[rows], "event_order": order[rows], "k": k[rows]})
        made["before_global_step"], made["before_event_order"] = where(step[back]), where(order[back])
        made["before_k"], made["overlap"] = where(k[back]), where(shared / pooled)
        last = place[np.append(token[place[1:]] != token[place[:-1]], True)]
        flat = [int(e) for n in last for e in experts[n]]
        kept = (*[x[last].astype(int).tolist() for x in (token, step, order, k)], flat)
        return made, kept


BREAKER = "model_run string, component string, ord bigint, failed boolean"


class Breaker(Ordered):
    """Per run: the rows that components write until they fail.

    A failing component is off from that place on and the others go on; a failure of anything that is
    no component turns all of them off. The state is the first failing place of each component.
    """

    order = ("ord",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.off = handle.getMapState("off", "component string", "at bigint")

    def rows(self, key, frame):
        failed = frame[frame["failed"]]
        for component in COMPONENTS:
            hits = failed.loc[(failed["component"] == component) | ~failed["component"].isin(COMPONENTS), "ord"]
            # A place that is held came before all of these.
            if len(hits) and not self.off.containsKey((component,)):
                self.off.updateValue((component,), (int(hits.min()),))
        first = {component: at for (component,), (at,) in self.off.iterator()}
        limit = frame["component"].map(lambda c: first.get(c, np.iinfo(np.int64).max))
        kept = frame["component"].isin(COMPONENTS) & (frame["ord"] < limit)
        yield frame.loc[kept, ["component", "ord", "failed"]].assign(model_run=key[0])[["model_run", "component", "ord", "failed"]]

    def gone(self, key):
        self.off.clear()
        yield pd.DataFrame()


PENDING = "run_id string, step int, event_order int, module_name string"


class Pending(StatefulProcessor):
    """Per run: router events wait for the callback of their step, and are lost if it does not come.

    Rows are of ``kind`` event, step (its callback) or end (of the run). A callback drops the events of its
    step, whichever of them comes first. What is left at the end of the run, or when a run is silent for
    ``idle_ms``, is given out as never flushed.
    """

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "step int, event_order int, module_name string")
        self.steps = handle.getMapState("steps", "step int", "came boolean")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows))
        came = frame.loc[frame["kind"] == "step", "step"].unique().tolist()
        for step in came:
            self.steps.updateValue((int(step),), (True,))
        fresh = frame.loc[frame["kind"] == "event", ["step", "event_order", "module_name"]].drop_duplicates()
        waiting = set(self.events.get()) | set(fresh.itertuples(index=False, name=None))
        waiting = {(int(s), int(o), m) for s, o, m in waiting if not self.steps.containsKey((int(s),))}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if (frame["kind"] == "end").any():
            yield self._lost(key, waiting)
            self._clear()
            return
        self.events.put(sorted(waiting)) if waiting else self.events.clear()
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waiting = set(self.events.get())
        self._clear()
        yield self._lost(key, waiting)

    def _clear(self) -> None:
        self.events.clear()
        self.steps.clear()

    @staticmethod
    def _lost(key, waiting: set[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(sorted(waiting), columns=["step", "event_order", "module_name"])
        return found.assign(run_id=key[0])[["run_id", "step", "event_order", "module_name"]]

    def close(self) -> None:
        pass


def _processed(stream: DataFrame, keys: list[str], processor: StatefulProcessor, output: str) -> DataFrame:
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="ProcessingTime"
    )


def route_overlap_stream(tokens: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Per-token overlaps; ``routing.change_rates`` turns the sink into rates per event."""
    return _processed(tokens, ROUTE_KEYS, RouteOverlap(idle_ms), ROUTE_OVERLAP)


def breaker_stream(status: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Rows (model_run, component, ord, failed) that were written before their component failed."""
    return _processed(status, ["model_run"], Breaker(idle_ms), BREAKER)


def pending_events_stream(rows: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Router events (run_id, step, event_order, module_name) whose step's callback never came."""
    return _processed(rows, ["run_id"], Pending(idle_ms), PENDING)
