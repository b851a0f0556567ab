"""Stateful limits over streams of events: fixed windows from the first event, and token buckets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _in_order(frames: Iterator[pd.DataFrame], at: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(at, kind="stable")


def step_window(state: tuple[float, int] | None, now: float, seconds: float) -> tuple[float, int]:
    """Window start and count after an event: the window starts with its first event and ends once more than seconds have passed."""
    if state is None or state[0] < now - seconds:
        return now, 1
    return state[0], state[1] + 1


def step_bucket(state: tuple[float, float] | None, now: float, limit: int, seconds: float) -> tuple[float, float, bool]:
    """Tokens and time after an event, and whether it had a token: limit tokens refill evenly over seconds."""
    tokens, last = state if state is not None else (float(limit), now)
    tokens = min(float(limit), tokens + (now - last) * limit / seconds)
    return (tokens - 1, now, True) if tokens >= 1 else (tokens, now, False)


def _keep(state: GroupState, value: tuple, until: float) -> None:
    """Store value until the watermark passes until (seconds)."""
    state.update(value)
    state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))


def window_quota(events: DataFrame, key: str, at: str, event_id: str, limit: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """key, event_id, n, ok of each event of a stream: its number in its key's window, and whether that is within limit.

    State per key is a start and a count. Events of one micro-batch are taken in the order of their time, those later
    than late are dropped; a key's state goes once the watermark is past its window.
    """
    kinds = dict(events.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        rows = []
        for i, now in _in_order(frames, at)[[event_id, at]].itertuples(index=False):
            old = step_window(old, pd.Timestamp(now).timestamp(), seconds)
            rows.append((k[0], i, old[1], old[1] <= limit))
        _keep(state, old, old[0] + 2 * seconds)
        yield pd.DataFrame(rows, columns=[key, event_id, "n", "ok"])

    return events.select(key, at, event_id).withWatermark(at, late).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{event_id}` {kinds[event_id]}, n long, ok boolean", "start double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket(events: DataFrame, key: str, at: str, event_id: str, limit: int, seconds: float, late: str = "1 hour") -> DataFrame:
    """key, event_id, ok of each event of a stream: whether its key's bucket had a token."""
    kinds = dict(events.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        rows = []
        for i, now in _in_order(frames, at)[[event_id, at]].itertuples(index=False):
            *old, ok = step_bucket(old, pd.Timestamp(now).timestamp(), limit, seconds)
            rows.append((k[0], i, ok))
        _keep(state, tuple(old), old[1] + 2 * seconds)
        yield pd.DataFrame(rows, columns=[key, event_id, "ok"])

    return events.select(key, at, event_id).withWatermark(at, late).groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, `{event_id}` {kinds[event_id]}, ok boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)
