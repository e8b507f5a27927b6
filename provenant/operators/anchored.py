"""Windows anchored at events: the first event of a key opens a window of W seconds, later ones
fall into it, and the first event after its end opens the next.

Which events open windows depends on the one before, so a key is one chain. The chain is cut
into slabs of time. A slab is summarised as a step function from "the open window ends at x" to
"the window open when the slab is over ends at y"; composing those steps per key gives the state
in which every slab starts, and slabs are then finished independently. A task holds one slab of
one key at a time, never a whole key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from provenant.plans.skew import running_number
from provenant.settings import Settings

_SECOND = 1_000_000
_NEVER = np.iinfo(np.int64).min
_NUMBER_SLABS = 16


def _whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted frames so that no group is split between two of them."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = frame[by].iloc[-1]
        open_rows = (frame[by] == last).all(axis=1).to_numpy()
        if open_rows.all() and rest and (rest[-1][by].iloc[-1] == last).all():
            rest.append(frame)
            continue
        yield pd.concat([*rest, frame[~open_rows]]).reset_index(drop=True) if rest else frame[~open_rows].reset_index(drop=True)
        rest = [frame[open_rows]]
    if rest:
        yield pd.concat(rest).reset_index(drop=True)


class _Slabs:
    """The events of several slabs laid on one line, so that all are handled at once."""

    def __init__(self, frame: pd.DataFrame, width: int, span: int):
        group = frame[["_key", "_slab"]]
        self.first = (group != group.shift()).any(axis=1).to_numpy()
        self.of = np.cumsum(self.first) - 1
        self.start = frame["_slab"].to_numpy(np.int64) * span
        self.stride = span + width + 1
        self.line = self.of * self.stride + (frame["_us"].to_numpy(np.int64) - self.start)
        self.width = width
        follow = np.searchsorted(self.line, self.line + width, side="left")
        ahead = np.minimum(follow, len(self.line) - 1)
        self.inside = (follow < len(self.line)) & (self.of[ahead] == self.of)
        self.follow = np.where(self.inside, ahead, np.arange(len(self.line)))


def _summaries(width: int, span: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, ["_key", "_slab"]):
            if not len(frame):
                continue
            slabs = _Slabs(frame, width, span)
            last = slabs.follow
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            us = frame["_us"].to_numpy(np.int64)
            leaves = us[last] + width
            # A window open at the start ends within one width of it: later steps are not used.
            early = us < slabs.start + width
            used = slabs.first | early | np.append(False, early[:-1] & ~slabs.first[1:])
            frame = frame.assign(_leaves=leaves)[used]
            same = (frame[["_key", "_slab", "_leaves"]] == frame[["_key", "_slab", "_leaves"]].shift(-1)).all(axis=1)
            yield frame[~same][["_key", "_slab", "_us", "_leaves"]]
    return run


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the steps of each key in order; only the state of the current slab is carried."""
    key, slab, entry, opened, moved = None, None, _NEVER, _NEVER, False
    for frame in frames:
        found = []
        for this, part, us, leaves in zip(*(frame[c].tolist() for c in ("_key", "_slab", "_us", "_leaves"))):
            if this != key or part != slab:
                if this != key:
                    opened = _NEVER
                key, slab, entry, moved = this, part, opened, False
                found.append((key, slab, entry))
            if not moved and us >= entry:
                opened, moved = leaves, True
        if found:
            yield pd.DataFrame(found, columns=["_key", "_slab", "_entry"])


def _anchors(width: int, span: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, ["_key", "_slab"]):
            if not len(frame):
                continue
            slabs = _Slabs(frame, width, span)
            us, entry = frame["_us"].to_numpy(np.int64), frame["_entry"].to_numpy(np.int64)
            free = us >= entry
            # The first free event of each slab opens a window; follow the chain from there.
            current = np.flatnonzero(free & (slabs.first | ~np.append(False, free[:-1])))
            opens = np.zeros(len(us), bool)
            while len(current):
                opens[current] = True
                current = slabs.follow[current[slabs.inside[current]]]
            at = np.maximum.accumulate(np.where(opens, np.arange(len(us)), -1))
            own = (at >= 0) & (slabs.of[np.maximum(at, 0)] == slabs.of)
            anchor = np.where(own, us[np.maximum(at, 0)], entry - width)
            yield frame.assign(_anchor=anchor)[["_key", "_us", "_anchor"]]
    return run


def anchors(events: DataFrame, key: str, ts: str, seconds: int, tie: str, slab_seconds: int | None = None) -> DataFrame:
    """(_key, _us, _first, _anchor): per distinct key and time, the smallest ``tie`` value and
    the time at which the window holding it opened."""
    width = seconds * _SECOND
    span = max(width, slab_seconds * _SECOND) if slab_seconds else max(4 * width, 3600 * _SECOND)
    kind = events.schema[key].dataType.simpleString()
    moments = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(
        F.col(key).alias("_key"), _micros(ts).alias("_us")).agg(F.min(tie).alias("_first"))
    moments = moments.withColumn("_slab", F.floor(F.col("_us") / F.lit(span)).cast("bigint"))
    spread = moments.select("_key", "_slab", "_us").repartition("_key", "_slab").sortWithinPartitions("_key", "_slab", "_us")
    steps = spread.mapInPandas(_summaries(width, span), f"_key {kind}, _slab bigint, _us bigint, _leaves bigint")
    entries = steps.repartition("_key").sortWithinPartitions("_key", "_slab", "_us").mapInPandas(
        _entries, f"_key {kind}, _slab bigint, _entry bigint")
    ready = spread.join(entries, ["_key", "_slab"]).repartition("_key", "_slab").sortWithinPartitions("_key", "_slab", "_us")
    opened = ready.mapInPandas(_anchors(width, span), f"_key {kind}, _us bigint, _anchor bigint")
    return moments.select("_key", "_us", "_first").join(opened, ["_key", "_us"])


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _placed(events: DataFrame, key: str, ts: str, seconds: int, tie: str, slab_seconds: int | None) -> DataFrame:
    found = anchors(events, key, ts, seconds, tie, slab_seconds)
    keyed = events.withColumns({"_key": F.col(key), "_us": _micros(ts)})
    return keyed.join(found, ["_key", "_us"])


def _moment(micros: str) -> Column:
    return F.timestamp_micros(F.col(micros))


def anchored_window(events: DataFrame, key: str, ts: str, seconds: int, limit: int, tie: str,
                    slab_seconds: int | None = None) -> DataFrame:
    """Events with window_start, n_in_window and flagged (number over the limit)."""
    placed = _placed(events, key, ts, seconds, tie, slab_seconds)
    part = F.floor((F.col("_us") - F.col("_anchor")) * _NUMBER_SLABS / F.lit(seconds * _SECOND))
    numbered = running_number(placed, ["_key", "_anchor"], [F.col("_us"), F.col(tie)], part, "n_in_window")
    return numbered.withColumns({"window_start": _moment("_anchor"), "flagged": F.col("n_in_window") > limit}).drop(
        "_key", "_us", "_first", "_anchor")


def rate_flags(log: DataFrame, key: str = "ip_hash", ts: str = "created_at", tie: str = "id",
               settings: Settings = Settings()) -> DataFrame:
    return anchored_window(log, key, ts, settings.rate_limit_seconds, settings.rate_limit_max, tie)


def cache_replay(log: DataFrame, key: str, ts: str, tie: str, ttl: int = Settings.cache_ttl_seconds,
                 slab_seconds: int | None = None) -> DataFrame:
    """Events with ``hit``: whether a cache of that lifetime would have answered."""
    placed = _placed(log, key, ts, ttl, tie, slab_seconds)
    miss = (F.col("_us") == F.col("_anchor")) & (F.col(tie) == F.col("_first"))
    return placed.withColumn("hit", ~miss).drop("_key", "_us", "_first", "_anchor")


def hit_rate(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count(F.lit(1)).alias("requests"), F.count_if("hit").alias("hits"),
                        F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("hit_rate"))
