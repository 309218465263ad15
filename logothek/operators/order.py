"""Exact ranks and prefix sums over a total order, without a window that holds a whole group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logothek.session import checkpointed


def running_sum(rows: DataFrame, group: str | None, order: list[str], value: str | None, name: str = "running", partitions: int | None = None) -> DataFrame:
    """``rows`` with the sum of a long column over the rows of the group up to each, itself included; None sums ones.

    order: columns whose last is unique within a group. Rows are range-partitioned by (group, order), so a group of any size
    is spread over tasks; the driver sees one number for each partition and group that meets it (at most partitions +
    groups). The sorted rows are checkpointed between the two passes, so that a lost executor can't move a row to another
    partition. Null groups are one group, null values count as 0.
    """
    keys = [F.col(c) for c in ([group] if group else []) + order]
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = checkpointed(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    by = ["_part", *([group] if group else [])]
    sums = part.groupBy(*by).agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("_n") if value else F.count("*").alias("_n")).collect()
    before: dict[tuple, int] = {}
    done: dict = {}
    for r in sorted(sums, key=lambda r: r["_part"]):
        g = r[group] if group else None
        before[r["_part"], g] = done.get(g, 0)
        done[g] = done.get(g, 0) + r["_n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column(b.schema.get_field_index("_part"))[0].as_py()
            v = pc.fill_null(b.column(b.schema.get_field_index(value)).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) if value else np.ones(b.num_rows, np.int64)
            total = np.cumsum(v)
            starts, names = np.zeros(1, np.int64), [None]
            if group:
                coded = b.column(b.schema.get_field_index(group)).dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                names = [None if codes[i] < 0 else coded.dictionary[int(codes[i])].as_py() for i in starts]
            base = np.empty(len(starts), np.int64)
            for k, (i, g) in enumerate(zip(starts, names, strict=True)):
                if k or g != last:
                    at = before[p, g]
                base[k] = at - (total[i - 1] if i else 0)
                at += int(total[(starts[k + 1] if k + 1 < len(starts) else len(v)) - 1] - (total[i - 1] if i else 0))
                last = g
            running = total + np.repeat(base, np.diff(np.concatenate((starts, [len(v)]))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(running)], schema=b.schema.append(pa.field(name, pa.int64())))

    return part.mapInArrow(add, StructType([*part.schema.fields, StructField(name, LongType())])).drop("_part")


def ranked(rows: DataFrame, group: str | None, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``rank``: the position from 0 of each row within its group by ``order``, whose last column is unique."""
    return running_sum(rows, group, order, None, "rank", partitions).withColumn("rank", F.col("rank") - 1)
