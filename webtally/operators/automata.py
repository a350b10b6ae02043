"""State machines over the events of a key, in pieces.

Events are sorted by key and time over the whole cluster and cut into pieces of rows, wherever that falls: a key with a
third of all events is simply several pieces. What a piece does to the state of the key it begins with is a function that is
made without knowing that state, its *summary*. One small row a piece, the summaries are followed one after the other from
piece to piece; then every piece is judged on its own, from the state it begins with. No pause is needed anywhere.

A key may come with a state of its own, from an earlier batch: a row of kind 0 before its events.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import reliable_checkpoint

State = list[int]


def _last_in_chain(following: np.ndarray) -> np.ndarray:
    """For each element the end of the chain of next elements; an end follows itself. By pointer doubling."""
    while True:
        further = following[following]
        if np.array_equal(further, following):
            return following
        following = further


def _runs(bounds: np.ndarray, *columns: np.ndarray) -> list[list[int]]:
    """Rows whose columns equal those of the next one are left out: the bound of the last one holds for all."""
    if not len(bounds):
        return [[], *([] for _ in columns)]
    differs = np.append(np.any([c[1:] != c[:-1] for c in columns], axis=0), True)
    return [bounds[differs].tolist(), *(c[differs].tolist() for c in columns)]


class Lockout:
    """``attempts`` failures of a key within ``window`` lock it for ``lockout``; times in µs. State: end of the lock, failures.

    Where a lock is shorter than the window, failures outlive it and entries do not start anew: then keys stay whole.
    """

    verdict = "string"

    def __init__(self, attempts: int, window: int, lockout: int):
        self.attempts, self.window, self.lockout = attempts, window, lockout
        self.divides = lockout >= window

    def begin(self, state: Sequence[int] | None) -> State:
        return list(state) if state is not None and len(state) else [0]

    def step(self, state: State, now: int, flag: bool) -> str:
        """``blocked``, ``success``, ``failure`` or ``locked`` (this failure locks)."""
        if now < state[0]:
            return "blocked"
        if flag:
            state[:] = [0]
            return "success"
        state[:] = [0, *(t for t in state[1:] if t > now - self.window), now]
        if len(state) > self.attempts:
            state[0] = now + self.lockout
            return "locked"
        return "failure"

    def summary(self, us: np.ndarray, flag: np.ndarray) -> list[list[int]]:
        """From where on which lock is the last of the piece.

        A piece entered unlocked and without failures at event i locks at the first failure that has enough failures
        before it, from i on, with no success in between and within the window; the first event after the lock is the
        next such entry. So entries form chains, and the end of each chain is found for all entries at once.
        """
        failed = np.flatnonzero(~flag)
        successes = np.cumsum(flag)
        back = self.attempts - 1
        last, first = failed[back:], failed[: max(len(failed) - back, 0)]
        locks = (successes[last] == successes[first]) & (us[first] > us[last] - self.window)
        last, first = last[locks], first[locks]
        until = us[last] + self.lockout
        entry = np.searchsorted(us, until, "left")  # the first event that is not blocked any more
        following = np.searchsorted(first, entry, "left")
        ends = (entry == len(us)) | (following == len(first))
        chain = _last_in_chain(np.where(ends, np.arange(len(first)), following))
        # the piece ends locked, or unlocked with the failures since an entry
        locked = (entry == len(us))[chain]
        value = np.where(locked, until[chain], us[np.minimum(entry[chain], len(us) - 1)])
        past = int(np.flatnonzero(flag)[-1]) if flag.any() else -1
        tail = us[failed[failed > past]][-back:] if back else us[:0]
        early = us[failed[: back if past < 0 else int(np.searchsorted(failed, np.flatnonzero(flag)[0]))][:back]]
        return [*_runs(us[first], locked.astype(np.int64), value), tail.tolist(), early.tolist(), [int(us[0]), int(us[-1]), int(past >= 0)]]

    def follow(self, summary: Sequence[Sequence[int]], state: Sequence[int] | None) -> State:
        bounds, locked, values, tail, early, (begins, ends, has_success) = summary
        until, failures = (state[0], list(state[1:])) if state is not None and len(state) else (0, [])
        if until <= begins:
            # failures from before can only lock together with the first ones of the piece
            for n, now in enumerate(early):
                if sum(t > now - self.window for t in [*failures, *early[: n + 1]]) >= self.attempts:
                    until, failures = now + self.lockout, []
                    break
        if until > ends:
            return [until, *failures]
        since = until if until > begins else begins
        at = bisect_left(bounds, since)
        if at < len(bounds):
            if locked[at]:
                return [values[at]]
            return [0, *(t for t in tail if t >= values[at])]
        kept = [] if has_success or until > begins else failures
        return [0, *[*kept, *(t for t in tail if t >= since)][-max(self.attempts - 1, 0) or len(tail) + len(kept) :]]


class Rate:
    """At most ``limit`` requests in a window of ``span`` µs that starts with a request. State: start and count."""

    verdict = "boolean"

    def __init__(self, limit: int, span: int):
        self.limit, self.span, self.divides = limit, span, True

    def begin(self, state: Sequence[int] | None) -> State:
        return list(state) if state is not None and len(state) else []

    def step(self, state: State, now: int, flag: bool) -> bool:
        if not state or now - state[0] > self.span:
            state[:] = [now, 1]
            return True
        if state[1] >= self.limit:
            return False
        state[1] += 1
        return True

    def summary(self, us: np.ndarray, flag: np.ndarray) -> list[list[int]]:
        """For every event as the start of a window the start of the last window of the piece, and what it holds."""
        following = np.searchsorted(us, us + self.span, "right")
        chain = _last_in_chain(np.where(following == len(us), np.arange(len(us)), following))
        return [*_runs(us, us[chain], np.minimum(len(us) - chain, self.limit)), [len(us)]]

    def follow(self, summary: Sequence[Sequence[int]], state: Sequence[int] | None) -> State:
        bounds, starts, counts, (n,) = summary
        if state is None or not len(state):
            return [starts[0], counts[0]]
        at = bisect_left(bounds, state[0] + self.span + 1)
        if at < len(bounds):
            return [starts[at], counts[at]]
        return [state[0], min(self.limit, state[1] + n)]


def _joined(parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, State | None]:
    """Times, flags and the state that a run of one key brings along."""
    kind = np.concatenate([p["kind"].to_numpy() for p in parts])
    us, flag = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("us", "flag"))
    own = list(parts[0]["state"].iloc[0]) if kind[0] == 0 else None
    return us[kind == 1], flag[kind == 1].astype(bool), own


def _summaries(placed: DataFrame, machine) -> DataFrame:
    """One row a piece: its first key and what the piece does to its state, its last key and the state of that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, leading, key, parts = None, True, None, []
        for batch in batches:
            keys = batch["key"].to_numpy()
            ends = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1 if len(keys) else []
            # only the first and the last key of a piece reach beyond it
            spans = sorted({(0, int(ends[0])), (int(ends[-2]) if len(ends) > 1 else 0, len(keys))}) if len(keys) else []
            for a, b in spans:
                if parts and keys[a] != key:
                    if leading:
                        first, leading = (key, parts), False
                    parts = []
                key = keys[a]
                parts.append(batch.iloc[a:b])
        if not parts:
            return
        run_first = first if first is not None else (key, parts)
        us, flag, own = _joined(run_first[1])
        state = None
        if first is not None:
            last_us, last_flag, last_own = _joined(parts)
            state = machine.follow(machine.summary(last_us, last_flag), last_own) if len(last_us) else machine.begin(last_own)
        yield pd.DataFrame({
            "piece": [TaskContext.get().partitionId()], "first_key": [run_first[0]], "own": [own],
            "summary": [machine.summary(us, flag) if len(us) else None], "last_key": [key], "state": [state],
        })

    return placed.mapInPandas(run, "piece int, first_key string, own array<bigint>, summary array<array<bigint>>, last_key string, state array<bigint>")


def _entered(summaries: DataFrame, machine) -> dict[int, State]:
    """The state in which each piece is entered, where it is not a new one; one small row a piece is looked at at a time."""
    entered: dict[int, State] = {}
    before: tuple[str | None, State] | None = None
    # written first: sorting samples its input, which would make every summary twice
    for row in reliable_checkpoint(summaries).orderBy("piece").toLocalIterator():
        state = row["own"]
        if state is None and before is not None and before[0] == row["first_key"]:
            state = entered[row["piece"]] = before[1]
        if row["state"] is not None:
            after = row["state"]
        elif row["summary"] is not None:
            after = machine.follow(row["summary"], state)
        else:
            after = machine.begin(state)
        before = (row["last_key"], list(after))
    return entered


def judged(events: DataFrame, machine, states: DataFrame | None = None) -> DataFrame:
    """Verdicts of ``events`` (key, us, event_id, flag), in order of time, then id.

    Rows of kind 1 are events with their verdict. Rows of kind 0 have the ``state`` of a key after the last event of a
    ``piece`` and the time of that event; the largest piece of a key counts. ``states`` (key, state) are those before.
    """
    none = F.lit(None)
    rows = events.select("key", F.lit(1).alias("kind"), "us", "event_id", "flag", none.cast("array<bigint>").alias("state"))
    if states is not None:
        known = states.join(events.select("key").distinct(), "key", "left_semi")
        rows = rows.unionByName(known.select("key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("event_id"), F.lit(False).alias("flag"), "state"))
    order = ("key", "kind", "us", "event_id")
    dealt = rows.repartitionByRange(*order) if machine.divides else rows.repartition("key")
    placed = reliable_checkpoint(dealt.sortWithinPartitions(*order))
    entered = _entered(_summaries(placed, machine), machine) if machine.divides else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = TaskContext.get().partitionId()
        key, state, last, started = None, machine.begin(entered.get(piece)), None, False
        for batch in batches:
            verdicts, ended = [], []
            for k, kind, us, flag, own in zip(*(batch[c].tolist() for c in ("key", "kind", "us", "flag", "state"))):
                if k != key or not started:
                    if started:
                        if last is not None:
                            ended.append((key, 0, last, state))
                        state, last = machine.begin(None), None
                    key, started = k, True
                if kind == 0:
                    state = machine.begin(own)
                    verdicts.append(None)
                else:
                    last = us
                    verdicts.append(machine.step(state, us, flag))
            yield result(batch[batch["kind"] == 1], [v for v in verdicts if v is not None], ended)
        if last is not None:
            yield result(pd.DataFrame({c: [] for c in ("key", "us", "event_id", "flag")}), [], [(key, 0, last, state)])

    def result(rows: pd.DataFrame, verdicts: list, ended: list) -> pd.DataFrame:
        piece = TaskContext.get().partitionId()
        out = pd.DataFrame({"key": rows["key"], "kind": 1, "us": rows["us"], "event_id": rows["event_id"], "flag": rows["flag"], "verdict": verdicts, "state": None, "piece": piece})
        more = pd.DataFrame([(k, 0, us, None, None, None, list(state), piece) for k, _, us, state in ended], columns=out.columns)
        parts = [p for p in (out, more) if len(p)]
        return pd.concat([p.astype(object) for p in parts]) if parts else out

    schema = f"key string, kind int, us bigint, event_id bigint, flag boolean, verdict {machine.verdict}, state array<bigint>, piece int"
    return placed.mapInPandas(run, schema)


def last_states(rows: DataFrame) -> DataFrame:
    """key, state and time of the last event, from what ``judged`` gives."""
    last = F.max_by(F.struct("state", F.col("us").alias("last_us")), "piece")
    return rows.filter("kind = 0").groupBy("key").agg(last.alias("s")).select("key", "s.state", "s.last_us")
