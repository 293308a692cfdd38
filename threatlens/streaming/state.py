"""Per-key sequential decisions (T4 sliding-log throttle, T5 TTL reuse).

Both depend on earlier *decisions* of the same key (a rejected call is not
recorded; a cache hit does not refresh the entry), so they are folds, not window
counts.  T5 is T4 with a limit of one: a hit is a call that is not recorded.

A key's calls fall apart where a gap of at least the window empties the state:
each stretch between such gaps is decided alone, and ``decide`` takes all
stretches of a batch at once, ``limit`` calls of each a step: the next ``limit``
accepted calls are the first ones at least a window after the last ``limit``
accepted, found by binary search, so steps are counted in windows, not in calls.

Batch form: one range exchange on (key, time, tie), so a key of any size lies
in many partitions.  Each partition decides all stretches that begin in it.  What
it cannot decide is the stretch that it begins with, if that began before; its
entry state is the exit state of the partition before, and follows at once
unless a whole partition lies within one stretch.  Only for such runs of
partitions the times alone are read in order, a task a run, which hands each
partition its entry state; their rows are then decided in parallel too.

Stream form: the same ``decide`` inside ``applyInPandasWithState``, in event-time
order.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lists
from ..session import materialize


# ---- the rules, one call at a time (``decide`` gives the same answers) -----------------------------------------

class SlidingLog:
    """T4: keep accepted call times inside the window; a call is limited when
    ``limit`` accepted calls are still inside it, and limited calls are not
    recorded."""

    def __init__(self, limit: int, window_s: float, accepted=()):
        self.limit, self.window = limit, window_s
        self.log = deque(accepted)

    def step(self, t: float) -> bool:
        while self.log and t - self.log[0] >= self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            return True
        self.log.append(t)
        return False


class TtlAnchor:
    """T5: a request within ``ttl`` seconds of the stored result is a hit;
    otherwise it computes and stores a new result (the age never slides)."""

    def __init__(self, ttl_s: float, anchor: float | None = None):
        self.ttl, self.anchor = ttl_s, anchor

    def step(self, t: float) -> bool:
        if self.anchor is not None and t - self.anchor < self.ttl:
            return True
        self.anchor = t
        return False


# ---- all stretches of a batch at once -----------------------------------------------------

def decide(t: np.ndarray, head: np.ndarray, kept: list[int], limit: int, window: int) -> tuple[np.ndarray, list[int]]:
    """Whether each call is limited, and the last accepted times that still
    count after the last one.

    ``t``: times in order within stretches, ``head`` marks where a stretch
    begins; if the first call does not begin one, ``kept`` are the last accepted
    times before it.
    """
    n = len(t)
    first = np.flatnonzero(head)
    if not n or not len(first) or first[0]:
        first = np.r_[0, first].astype(np.int64)
    if not n:
        return np.zeros(0, bool), list(kept)
    end = np.r_[first[1:], n]
    # one increasing clock for all stretches: times within them, wide gaps between
    step = np.diff(t, prepend=t[0])
    step[first] = 2 * window + 1
    step[0] = 0
    clock = np.cumsum(step)
    log = np.full((len(first), limit), -2 * window, np.int64) + clock[first][:, None]
    if not head[0] and kept:
        recent = np.array(kept[-limit:], np.int64) - t[0]
        log[0, limit - len(recent):] = np.maximum(recent, -2 * window)
    order = np.arange(limit)
    accepted = np.zeros(n, bool)
    at, live, last = first.copy(), np.arange(len(first)), log[-1]
    while len(live):
        free = np.searchsorted(clock, (log[live] + window).ravel()).reshape(-1, limit)
        free = np.maximum(free, at[live, None])
        who = np.maximum.accumulate(free - order, axis=1) + order  # one call takes one place
        ok = who < end[live, None]
        accepted[who[ok]] = True
        whole = ok[:, -1]
        if live[-1] == len(first) - 1:
            mine = who[-1][ok[-1]]
            last = np.r_[log[-1][len(mine):], clock[mine]]
        log[live[whole]] = clock[who[whole]]
        at[live[whole]] = who[whole, -1] + 1
        live = live[whole & (at[live] < end[live])]
    last = last[clock[-1] - last < window]
    return ~accepted, (last + (t[-1] - clock[-1])).tolist()


def _key_codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal keys (nulls are one key)."""
    return pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()


# ---- batch form ------------------------------------------------------------------------

_MARKS = [T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()),
          T.StructField("_limited", T.BooleanType()), T.StructField("_edge", T.BooleanType()),
          T.StructField("_first", T.LongType()), T.StructField("_state", T.ArrayType(T.LongType()))]


def _sorted_fold(df: DataFrame, key: str, ts: str, limit: int, window: int, out_col: str, num_partitions: int | None,
                 tie: str | None = None):
    """Equal times are taken in the order of ``tie`` (an id), so the answers
    do not depend on the run; times are whole microseconds."""
    spark = df.sparkSession
    timed = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    parts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [key, "_t", *([tie] if tie else [])]
    ordered = timed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = [T.StructField(f.name, f.dataType) for f in timed.schema.fields]  # an edge row has nulls
    schema = T.StructType([*fields, *_MARKS])
    names = timed.columns

    def local(batches):
        """Decided rows, undecided ones of the first stretch, and an edge row:
        the partition's last key and time, its exit state if it is known."""
        from pyspark import TaskContext

        part, row, known, kept, last, first_t = TaskContext.get().partitionId(), 0, False, [], None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            t = batch.column("_t").to_numpy()
            codes = _key_codes(batch.column(key))
            head = np.r_[False, (codes[1:] != codes[:-1]) | (t[1:] - t[:-1] >= window)]
            now = batch.column(key)[0].as_py()
            if last is None:
                first_t, first_key = int(t[0]), batch.column(key).slice(0, 1)
            else:
                head[0] = last[0] != now or t[0] - last[1] >= window
            limited = np.zeros(n, bool)
            open_ = n if not head.any() else int(np.argmax(head))
            lo = 0 if known else open_
            if lo < n:
                limited[lo:], kept = decide(t[lo:], head[lo:], kept, limit, window)
            mask = np.arange(n) < lo
            known = known or lo < n
            last = batch.column(key)[n - 1].as_py(), int(t[-1])
            last_key = batch.column(key).slice(n - 1, 1)
            marks = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(limited, mask=mask),
                     pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], schema.names)
            row += n
        if last is not None:
            for edge_key, t, first, state in ((first_key, first_t, True, None), (last_key, last[1], False, kept if known else None)):
                columns = [edge_key if c == key else pa.array([t], pa.int64()) if c == "_t" else pa.nulls(1, f.type)
                           for c, f in zip(names, batch.schema)]
                marks = [pa.array([part], pa.int32()), pa.array([-1 if first else row], pa.int64()), pa.nulls(1, pa.bool_()),
                         pa.array([True]), pa.array([first_t], pa.int64()), pa.array([state], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *marks], schema.names)

    rows = materialize(ordered.mapInArrow(local, schema), "fold")
    edges = rows.where("_edge").select("_part", "_row", F.col(key).alias("k"), "_t", "_first", "_state").orderBy(
        "_part", "_row").collect()  # two rows a partition
    entry, chains, before = {}, [], None
    for first, end in zip(edges[::2], edges[1::2]):
        p = first["_part"]
        goes_on = before is not None and before[0] == first["k"] and first["_t"] - before[1] < window
        entry[p] = (before[2] if goes_on else [])
        state = end["_state"]
        if state is None:  # the partition lies within one stretch
            if goes_on and before[3]:
                chains[-1][1].append(p)
            else:
                chains.append((entry[p], [p]))
            entry[p] = None
        before = end["k"], end["_t"], state, state is None
    if chains:
        entry |= _chained(rows, chains, limit, window)
        # partitions that go on after a chain take its exit state
        for first, (p0, e0) in zip(edges[2::2], zip([e["_part"] for e in edges[1::2]], edges[1::2])):
            if first["k"] == e0["k"] and first["_t"] - e0["_t"] < window and e0["_state"] is None:
                entry[first["_part"]] = entry[p0, "exit"]
    entry = {p: s for p, s in entry.items() if not isinstance(p, tuple)}

    def rest(batches):
        at, kept = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, part = batch.column("_t").to_numpy(), batch.column("_part").to_numpy()
            head = np.zeros(len(t), bool)
            flags = np.zeros(len(t), bool)
            cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(t)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if part[lo] != at:
                    at, kept = part[lo], entry[int(part[lo])]
                flags[lo:hi], kept = decide(t[lo:hi], head[lo:hi], kept, limit, window)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out_names[:-1]], pa.array(flags)], out_names)

    keep = [c for c in names if c != "_t"]
    out_names = [*keep, out_col]
    done = rows.where("_limited is not null").select(*keep, F.col("_limited").alias(out_col))
    open_rows = rows.where("_limited is null and not _edge").select(*names, "_part", "_row")
    open_rows = open_rows.repartition(parts, "_part").sortWithinPartitions("_part", "_row")
    out_schema = T.StructType([*[f for f in fields if f.name in keep], T.StructField(out_col, T.BooleanType())])
    return done.unionByName(open_rows.mapInArrow(rest, out_schema))


def _chained(rows: DataFrame, chains: list, limit: int, window: int) -> dict:
    """Entry states of the partitions of each chain, and the exit state of its
    last one (under (partition, "exit")): their times alone are read in order,
    a chain a task."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(p, c) for c, (_, ps) in enumerate(chains) for p in ps], "_part int, chain int")
    starts = {c: kept for c, (kept, _) in enumerate(chains)}

    def run(batches):
        at, kept, out = (None, None), [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            chain, part, t = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (chain[1:] != chain[:-1])) + 1, len(t)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if chain[lo] != at[0]:
                    kept = starts[int(chain[lo])]
                elif part[lo] == at[1]:
                    out.pop()
                if part[lo] != at[1] or chain[lo] != at[0]:
                    out.append((int(part[lo]), False, kept))
                at = chain[lo], part[lo]
                _, kept = decide(t[lo:hi], np.zeros(hi - lo, bool), kept, limit, window)
                out.append((int(part[lo]), True, kept))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (
                pa.int32(), pa.bool_(), pa.list_(pa.int64())))], ["part", "done", "state"])

    times = rows.where("_limited is null and not _edge").select("_part", "_row", "_t").join(F.broadcast(table), "_part")
    states = (times.repartition(len(chains), "chain").sortWithinPartitions("chain", "_part", "_row")
              .select("chain", "_part", "_t").mapInArrow(run, "part int, done boolean, state array<long>").collect())
    return {((r["part"], "exit") if r["done"] else r["part"]): list(r["state"]) for r in states}  # two a partition


def _micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def throttle(df: DataFrame, key: str, ts: str, limit: int = lists.RATE_LIMIT,
             window_s: float = lists.RATE_WINDOW_SECONDS, num_partitions: int | None = None,
             tie: str | None = None) -> DataFrame:
    """T4 batch form: adds ``limited`` to every call row."""
    window = _micros(window_s)
    return _sorted_fold(df, key, ts, limit, window, "limited", num_partitions, tie)


def ttl_reuse(df: DataFrame, key: str, ts: str, ttl_s: float = lists.CACHE_TTL_SECONDS,
              num_partitions: int | None = None, tie: str | None = None) -> DataFrame:
    """T5 batch form: adds ``cache_hit`` to every request row."""
    ttl = _micros(ttl_s)
    return _sorted_fold(df, key, ts, 1, ttl, "cache_hit", num_partitions, tie)


# ---- stream form --------------------------------------------------------------------------

def _ordered_fold_stream(stream: DataFrame, key: str, ts: str, id_col: str, delay: str, limit: int, window_s: float,
                         out_col: str) -> DataFrame:
    """The fold on a stream whose rows arrive out of order by up to ``delay``.

    Rows wait in the key's state until the watermark has passed them and are
    then folded in the order of (time, id), whatever batch or Arrow chunk
    brought them.  An event-time timer wakes the key for the next waiting row,
    and drops its state once a window after its last decision nothing can
    depend on it; a backfill or a slow source forgets nothing.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, id_col)}
    out_schema = f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, `{ts}` timestamp, {out_col} boolean"
    state_schema = f"kept array<long>, times array<long>, ids array<{kinds[id_col]}>"
    hold = _micros(window_s)

    def fn(k, pdfs, state):
        kept, times, ids = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for pdf in pdfs:
                times += pdf["_t"].tolist()
                ids += pdf[id_col].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        rows = pd.DataFrame({"t": np.array(times, np.int64), "id": ids})
        ready = rows[rows["t"] <= mark].sort_values(["t", "id"], kind="stable")
        waiting = rows[rows["t"] > mark]
        t = ready["t"].to_numpy(np.int64)
        flags = np.zeros(0, bool)
        if len(t):
            head = np.r_[not kept or t[0] - kept[-1] >= hold, t[1:] - t[:-1] >= hold]
            flags, kept = decide(t, head, kept, limit, hold)
        if len(waiting) or (kept and kept[-1] + hold > mark):
            state.update((kept, waiting["t"].tolist(), waiting["id"].tolist()))
            wake = int(waiting["t"].min()) if len(waiting) else kept[-1] + hold
            state.setTimeoutTimestamp(max(mark // 1000, -(-wake // 1000)) + 1)
        elif state.exists:
            state.remove()
        if len(t):
            yield pd.DataFrame({key: [k[0]] * len(t), id_col: ready["id"].tolist(), ts: pd.to_datetime(t, unit="us"),
                                out_col: flags})

    timed = (stream.select(key, id_col, F.col(ts).cast("timestamp").alias(ts))
             .withColumn("_t", F.unix_micros(ts)).withWatermark(ts, delay))
    return timed.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                     GroupStateTimeout.EventTimeTimeout)


def throttle_stream(stream: DataFrame, key: str, ts: str, id_col: str, limit: int = lists.RATE_LIMIT,
                    window_s: float = lists.RATE_WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """T4 on a stream: key, id, time and ``limited`` of every call, once the
    watermark (``delay`` behind the latest call) has passed it."""
    return _ordered_fold_stream(stream, key, ts, id_col, delay, limit, window_s, "limited")


def ttl_reuse_stream(stream: DataFrame, key: str, ts: str, id_col: str, ttl_s: float = lists.CACHE_TTL_SECONDS,
                     delay: str = "10 minutes") -> DataFrame:
    """T5 on a stream: key, id, time and ``cache_hit`` of every request."""
    return _ordered_fold_stream(stream, key, ts, id_col, delay, 1, ttl_s, "cache_hit")
