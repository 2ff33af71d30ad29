"""Places in an order, however many rows share a group: no task sorts or holds a whole one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written


def ranked(df: DataFrame, group: str, order: Sequence[str | Column], into: str = "rank", carried: tuple[str, str] | None = None, purpose: str = "ranked") -> DataFrame:
    """df with a column `into`: each row's place, from 0, within its group by the order's columns. Null is a group like others; of rows that are equal in all of the order any may come first. carried: a column, and the name of another that gets its last value so far in the group that isn't null.

    Rows are dealt by ranges, sorted, numbered within each task's runs and written
    once. Only a range's first group can have begun in ranges before it, so what
    must be added is one row a range at most, and goes to every task.
    """
    at = df.columns.index(group)
    given = df.columns.index(carried[0]) if carried else None
    # Equal rows may be many: a number of no meaning lets ranges divide them.
    dealt = df.withColumn("_salt", F.monotonically_increasing_id())
    keys = [F.col(group), *order, "_salt"]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, held = TaskContext.get().partitionId(), None, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(at).dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
            begins = np.repeat(starts, np.diff(np.append(starts, len(codes))))
            run = np.arange(len(codes)) - begins
            goes_on = b.column(at)[0].as_py() == last and seen
            first = begins == 0
            if goes_on:
                run[first] += seen
            last, seen = b.column(at)[-1].as_py(), int(run[-1]) + 1
            extra = [pa.array(run, pa.int64()), pa.array(np.full(len(run), part), pa.int32())]
            if carried:
                values = b.column(given)
                known = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(len(codes)), -1))
                filled = values.take(pa.array(known, mask=known < begins))
                if goes_on and held is not None:
                    filled = pc.if_else(pa.array(first & (known < 0)), pa.scalar(held, filled.type), filled)
                held = filled[-1].as_py()
                extra.append(filled)
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, into, "_part", *([carried[1]] if carried else [])])

    fields = T.StructType([*df.schema.fields, T.StructField(into, T.LongType()), T.StructField("_part", T.IntegerType()), *([T.StructField(carried[1], df.schema[carried[0]].dataType)] if carried else [])])
    rows = written(dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").mapInArrow(numbered, fields), purpose)
    runs = rows.groupBy("_part", group).agg(F.max(into).alias("_n"), *([F.max_by(carried[1], into).alias("_held")] if carried else []))
    so_far = Window.partitionBy(group).orderBy("_part")
    before = F.sum(F.col("_n") + 1).over(so_far) - F.col("_n") - 1
    held = [F.last("_held", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)).alias("_held")] if carried else []
    offsets = runs.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), before.alias("_before"), *held).where("_before > 0")
    joined = rows.join(F.broadcast(offsets), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left").withColumn(into, F.col(into) + F.coalesce("_before", F.lit(0)))
    if not carried:
        return joined.select(*df.columns, into)
    return joined.withColumn(carried[1], F.coalesce(carried[1], "_held")).select(*df.columns, into, carried[1])
