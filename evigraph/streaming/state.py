"""What was held before each update of a subject, carried over a stream, and the transitions it makes.

An update is (key, seq, node, answered, status). Its operative node is ``node`` where it has an answer, else 0; its committed
node is the same where the status commits, else 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that commit to their answer.
COMMITS, RESOLVED = ("resolved", "provisionally_resolved"), "resolved"
PRIOR = "prior_operative bigint, prior_committed bigint, last_committed bigint, prior_status string"
UPDATE = "key bigint, seq bigint, node bigint, answered boolean, status string"


def _now(c) -> tuple[Column, Column]:
    operative = F.when(c("answered"), c("node")).otherwise(F.lit(0))
    return operative, F.when(c("status").isin(*COMMITS), operative).otherwise(F.lit(0))


def transitions(rows: DataFrame) -> DataFrame:
    """(key, seq, event, previous, current) of updates with what was held before (PRIOR; all null for a first update)."""
    c = F.col
    operative, committed = _now(c)
    was, had, last = F.coalesce("prior_operative", F.lit(0)), F.coalesce("prior_committed", F.lit(0)), F.coalesce("last_committed", F.lit(0))
    known = c("prior_status").isNotNull()
    event = lambda test, name, a, b: F.when(known & test, F.struct(F.lit(name).alias("event"), a.cast("bigint").alias("previous"), b.cast("bigint").alias("current")))
    zero = F.lit(0)
    moved = (had != 0) & (committed != 0) & (committed != had)
    again = (had == 0) & (last != 0) & (committed != 0)
    events = F.array(
        event((was != 0) & (was != operative), "revision", was, operative),
        event((had != 0) & (had != committed), "decommitment", had, zero),
        event(moved | again, "recommitment", F.when(moved, had).otherwise(last), committed),
        event((c("prior_status") != RESOLVED) & (c("status") == RESOLVED) & (committed != 0), "resolution", zero, committed),
    )
    return rows.select("key", "seq", F.inline(F.array_compact(events)))


def with_prior(updates: DataFrame) -> DataFrame:
    """Updates of a table with PRIOR, by windows: the form for data at rest."""
    w = Window.partitionBy("key").orderBy("seq")
    operative, committed = _now(F.col)
    rows = updates.withColumns({"o": operative.cast("bigint"), "m": committed.cast("bigint")})
    held = F.last(F.when(F.col("m") != 0, F.col("m")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("key", "seq", "node", "answered", "status", F.lag("o").over(w).alias("prior_operative"), F.lag("m").over(w).alias("prior_committed"), held.alias("last_committed"), F.lag("status").over(w).alias("prior_status"))


def carried(stream: DataFrame) -> DataFrame:
    """The same for a stream of updates: one row of state a key; updates of a key must not come before earlier ones' batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0, 0, 0, ""]
        rows = pd.concat(frames).sort_values("seq")
        out = []
        for u in rows.itertuples(index=False):
            out.append([u.key, u.seq, u.node, u.answered, u.status, *held[:3], held[3] or None])
            operative = int(u.node) if u.answered else 0
            committed = operative if u.status in COMMITS else 0
            held = [operative, committed, committed or held[2], u.status]
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=[*rows.columns, "prior_operative", "prior_committed", "last_committed", "prior_status"])

    return stream.groupBy("key").applyInPandasWithState(run, f"{UPDATE}, {PRIOR}", PRIOR, "append", "NoTimeout")
