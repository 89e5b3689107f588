"""Spaced-repetition state from a review log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from inkstone.session import cut_lineage

# Box change per outcome and waiting time per box in seconds.
OUTCOMES = ["again", "hard", "good", "easy"]
INTERVALS = [600, 3600, 28800, 86400, 259200, 604800]
TOP_BOX = len(INTERVALS) - 1

_BOXES = np.arange(TOP_BOX + 1)
# What each outcome does to each of the six boxes.
STEPS = np.stack(
    [
        np.zeros(TOP_BOX + 1, dtype=np.int64),
        np.maximum(0, _BOXES - 1),
        np.minimum(TOP_BOX, _BOXES + 1),
        np.minimum(TOP_BOX, _BOXES + 2),
    ]
)

#: A stretch of an entry's log: its place in the log's order, the box that it makes of each box, the streak that it leaves or adds, its length.
SLICE = "part int, first_ts timestamp, last_ts timestamp, steps array<int>, since_again long, saw_again boolean, n long"
#: Stretches that are composed in one row.
FAN = 64


def outcome_code(outcome: Column) -> Column:
    code = F.lit(None).cast("int")
    for i, name in enumerate(OUTCOMES):
        code = F.when(outcome == name, i).otherwise(code)
    return code


def interval_seconds(box: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in INTERVALS]), box)


def compose(steps: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Product of the box maps of each run of equal ``group``, by pairwise halving."""
    out = np.tile(_BOXES, (groups, 1))
    while len(group):
        starts = np.r_[True, group[1:] != group[:-1]]
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(starts, np.arange(len(group)), 0))
        left = place % 2 == 0
        lone = left & np.r_[starts[1:], True]
        first = np.flatnonzero(left)
        merged = steps[first]
        pair = ~lone[first]
        merged[pair] = np.take_along_axis(steps[first[pair] + 1], merged[pair], axis=1)
        steps, group = merged, group[first]
        if np.r_[True, group[1:] != group[:-1]].all():
            out[group] = steps
            break
    return out


def _joined(a: dict, b: dict) -> dict:
    """Two stretches in a row as one."""
    return {
        **a,
        "last_ts": b["last_ts"],
        "steps": np.asarray(b["steps"])[np.asarray(a["steps"])],
        "since_again": b["since_again"] if b["saw_again"] else a["since_again"] + b["since_again"],
        "saw_again": a["saw_again"] or b["saw_again"],
        "n": a["n"] + b["n"],
    }


def _slices(key: str):
    """Compose a sorted partition's reviews to one stretch per entry, whatever the size of the batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict | None = None
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[key].to_numpy()
            starts = np.r_[True, keys[1:] != keys[:-1]]
            group = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            last = np.r_[first[1:], len(keys)] - 1
            code = batch["code"].to_numpy()
            maps = compose(STEPS[code], group, len(first))
            at = np.where(code == 0, np.arange(len(code)), -1)
            last_again = np.maximum.reduceat(at, first)
            out = pd.DataFrame(
                {
                    key: keys[first],
                    "part": batch["part"].to_numpy()[first],
                    "first_ts": batch["ts"].to_numpy()[first],
                    "last_ts": batch["ts"].to_numpy()[last],
                    "steps": list(maps.astype(np.int32)),
                    "since_again": last - np.maximum(last_again, first - 1),
                    "saw_again": last_again >= 0,
                    "n": last - first + 1,
                }
            )
            if held is not None:
                head = out.iloc[0].to_dict()
                if held[key] == head[key]:
                    held, out = _joined(held, head), out.iloc[1:]
                if len(out):
                    yield pd.DataFrame([held])
            if len(out):
                yield out.iloc[:-1]
                held = out.iloc[-1].to_dict()
        if held is not None:
            yield pd.DataFrame([held])

    return run


def merge_slices(slices: DataFrame, key: str, fan: int = FAN) -> DataFrame:
    """One stretch per entry out of its stretches, which compose in the order of ``part``.

    A tree: each round composes the stretches of ``fan`` neighbouring parts in one row, so no row ever
    holds more of them, and the number of rounds is the logarithm of the number of parts.
    """
    top = slices.agg(F.max("part")).first()[0]
    cell = F.struct("part", "first_ts", "last_ts", "steps", "since_again", "saw_again", "n")
    seed = F.struct(
        F.array(*[F.lit(b) for b in range(TOP_BOX + 1)]).alias("steps"), F.lit(0).cast("long").alias("since_again"),
        F.lit(False).alias("saw_again"), F.lit(0).cast("long").alias("n"),
    )

    def step(s: Column, p: Column) -> Column:
        return F.struct(
            F.transform(s.steps, lambda box: F.get(p.steps, box)).alias("steps"),
            F.when(p.saw_again, p.since_again).otherwise(s.since_again + p.since_again).alias("since_again"),
            (s.saw_again | p.saw_again).alias("saw_again"),
            (s.n + p.n).alias("n"),
        )

    while top is not None:
        wider = F.floor(F.col("part") / fan).cast("int").alias("part")
        near = slices.groupBy(key, wider).agg(F.array_sort(F.collect_list(cell)).alias("s"))
        folded = near.select(
            key, "part", F.get("s", F.lit(0))["first_ts"].alias("first_ts"), F.array_max(F.transform("s", lambda p: p.last_ts)).alias("last_ts"),
            F.aggregate("s", seed, step).alias("f"),
        )
        slices = folded.select(key, "part", "first_ts", "last_ts", "f.steps", "f.since_again", "f.saw_again", "f.n")
        if top < fan:
            break
        top, slices = top // fan, cut_lineage(slices)
    return slices


def replay_reviews(reviews: DataFrame, key: str = "entry_id", fan: int = FAN) -> DataFrame:
    """Final (box, due, streak, review_count) per entry from (key, ts, event_id, outcome).

    Reviews do not commute, but each is a map of six boxes and maps compose. The
    log is range-partitioned on (key, ts, event_id), so even one entry holding a
    third of it is cut across many partitions. A sorted partition shrinks to one composed map
    per entry, with the partition's number as its place in time; those are merged in a tree.
    """
    rows = reviews.select(key, "ts", "event_id", outcome_code(F.col("outcome")).alias("code")).filter("code is not null")
    order = [key, "ts", "event_id"]
    key_type = reviews.schema[key].dataType.simpleString()
    sliced = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # written once: bounds of ranges that a lost task drew anew would not fit the others
    slices = cut_lineage(sliced.mapInPandas(_slices(key), f"{key} {key_type}, {SLICE}"))
    folded = merge_slices(slices, key, fan).withColumn("box", F.get("steps", F.lit(0)))
    due = F.col("last_ts") + F.make_interval(secs=interval_seconds(F.col("box")))
    return folded.select(key, "box", due.alias("due"), F.col("since_again").alias("streak"), F.col("n").alias("review_count"))
