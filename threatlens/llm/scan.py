"""Running sums within the groups of a table, however large a group is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parallelism, staged


def running(df: DataFrame, key: str, order: list, sums: list[str], name: str) -> DataFrame:
    """``df`` with ``before_<c>`` for each column (long) of ``sums``: its sum
    over the rows of the same ``key`` (a long, not null) that come before in
    ``order``, modulo 2**64.

    The table is range-partitioned by key and order, so a group that holds a
    third of all rows lies in many partitions.  Each adds up its own rows; what
    came before a partition, one row of sums, follows from the last rows of the
    partitions before it.
    """
    fields = [*df.schema.fields, *(T.StructField(f"before_{c}", T.LongType()) for c in sums)]
    schema = T.StructType([*fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType())])
    names = [f.name for f in fields]

    def local(batches):
        from pyspark import TaskContext

        part, last, carry, row = TaskContext.get().partitionId(), None, [0] * len(sums), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            group = np.repeat(np.arange(len(head)), np.diff(head, append=n))
            out = []
            for c, x in enumerate(sums):
                v = batch.column(x).to_numpy().astype(np.int64)
                before = np.cumsum(v) - v
                before = before - before[head][group]
                if last == keys[0]:
                    before[:head[1] if len(head) > 1 else n] += np.int64(carry[c])
                carry[c] = (before[-1:] + v[-1:])[0]
                out.append(pa.array(before))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *out, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n))],
                schema.names)
            row += n

    parts = parallelism(df.sparkSession)
    ordered = df.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = staged(ordered.mapInArrow(local, schema), name)
    # the last row of each partition: its key, and that key's sums in the partition
    ends = rows.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("key"), *[
        F.struct(F.col(f"before_{c}").alias("b"), F.col(c).cast("long").alias("v")).alias(f"s{i}")
        for i, c in enumerate(sums)]), "_row").alias("e")).orderBy("_part").collect()  # a row a partition
    offsets, held, carry = {}, None, np.zeros(len(sums), np.int64)
    for r in ends:
        offsets[r["_part"]] = (held, carry)
        own = np.array([r["e"][f"s{i}"]["b"] for i in range(len(sums))], np.int64) + \
            np.array([r["e"][f"s{i}"]["v"] for i in range(len(sums))], np.int64)
        held, carry = r["e"]["key"], (carry + own if held == r["e"]["key"] else own)

    def whole(batches):
        for batch in batches:
            part, keys = batch.column("_part").to_numpy(), batch.column(key).to_numpy()
            columns = [batch.column(x) for x in names]
            add = np.zeros((len(sums), batch.num_rows), np.int64)
            for p in np.unique(part).tolist():
                held, carry = offsets[p]
                if held is not None:
                    add[:, (part == p) & (keys == held)] = carry[:, None]
            for i in range(len(sums)):
                at = len(names) - len(sums) + i
                columns[at] = pa.array(columns[at].to_numpy() + add[i])
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(whole, T.StructType(fields))
