"""Most frequent values by lossy counting.

Each task runs over its rows in buckets of 1 / error rows and keeps entries (value, count,
undercount): a value not kept when it comes may have been dropped before, but no more often
than there were buckets, and that number is its undercount.  After a bucket, entries whose
count and undercount together do not exceed the number of buckets so far are dropped.  A task
holds no more than log(error * rows) / error entries, whatever the number of values.

Several buckets are taken in one step here, as columns: counts of a step are added up by
value, new values get the number of buckets before the step, and dropping follows the step.
Any value dropped still had a true count of at most the number of buckets.

Summaries of tasks merge by adding up: for a value that a task has no entry for, that task
adds its number of buckets to the undercount.  Counts are thus guaranteed to lie between
``count_low`` and ``count_high``, which differ by at most error * rows: undercounts are at most the
buckets a task has completed, whose rows add up to no more than all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.staging import ship, stage

STEP_ROWS = 1 << 17


def _step(kept: pa.Table | None, rows: pa.Table, before: int, now: int) -> pa.Table:
    keys = rows.column_names
    new = rows.group_by(keys).aggregate([([], "count_all")]).rename_columns([*keys, "f"])
    new = new.append_column("delta", pa.array([before], pa.int64()).take(pa.array(bytearray(new.num_rows), pa.uint8())))
    both = pa.concat_tables([kept, new]) if kept is not None else new
    # an entry kept from before has the smaller undercount
    merged = both.group_by(keys).aggregate([("f", "sum"), ("delta", "min")]).rename_columns([*keys, "f", "delta"])
    return merged.filter(pc.greater(pc.add(merged["f"], merged["delta"]), now))


def summaries(rows: DataFrame, fields: Mapping[str, Sequence[str]], error: float) -> DataFrame:
    """One summary per task: rows (field, hi, lo, f, delta, buckets, rows_seen).

    ``fields``: name to its value columns, one or two bigints; a row counts for a field where
    none of them is null.  Each task and field also gives one row with f null that carries
    the number of its buckets, and of the rows of the table, for merging.
    """
    ship(rows.sparkSession)
    width = max(1, round(1 / error))
    columns = list(dict.fromkeys(c for cs in fields.values() for c in cs))
    plan = [(name, list(cs)) for name, cs in fields.items()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pa.Table | None] = dict.fromkeys(name for name, _ in plan)
        seen, total, waiting, n = dict.fromkeys(kept, 0), 0, [], 0

        def take() -> None:
            whole = pa.Table.from_batches(waiting)
            for name, cs in plan:
                own = whole.select(cs).drop_null()
                if own.num_rows:
                    before = seen[name] // width
                    seen[name] += own.num_rows
                    kept[name] = _step(kept[name], own, before, seen[name] // width)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                n += batch.num_rows
                total += batch.num_rows
                if n >= STEP_ROWS:
                    take()
                    waiting, n = [], 0
        if waiting:
            take()
        if not total:
            return
        for i, (name, cs) in enumerate(plan):
            t = kept[name]
            k = t.num_rows if t is not None else 0
            low = t[cs[-1]].cast(pa.int64()).combine_chunks() if k else pa.array([], pa.int64())
            high = (t[cs[0]].cast(pa.int64()).combine_chunks() if len(cs) > 1 else pa.array([0] * k, pa.int64())) if k else pa.array([], pa.int64())
            long = lambda xs: pa.array(xs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (k + 1), pa.string()),
                    pa.concat_arrays([high, long([None])]),
                    pa.concat_arrays([low, long([None])]),
                    pa.concat_arrays([t["f"].cast(pa.int64()).combine_chunks() if k else long([]), long([None])]),
                    pa.concat_arrays([t["delta"].cast(pa.int64()).combine_chunks() if k else long([]), long([None])]),
                    long([seen[name] // width] * (k + 1)),
                    long([0] * k + [total]),
                ],
                names=["field", "hi", "lo", "f", "delta", "buckets", "rows_seen"],
            )

    return rows.select(*columns).mapInArrow(count, "field string, hi bigint, lo bigint, f bigint, delta bigint, buckets bigint, rows_seen bigint")


def frequent(parts: DataFrame, support: float) -> DataFrame:
    """field, value_hi, value_lo, count_low, count_high, total: every value that may reach support * total.

    Merges summaries.  No value with a true count of support * total is missing, and at most
    1 / (support - error) per field are listed, as a value's true count is at most error * total below
    its count_high.  total counts all rows of the table, those without the field's value too.
    Summaries are staged first, so that counting runs once though they are read twice.
    """
    parts = stage(parts, "summaries")
    merged = parts.groupBy("field", "hi", "lo").agg(
        F.sum("f").alias("f"), F.sum(F.col("delta") - F.col("buckets")).alias("spared"), F.sum("buckets").alias("buckets"), F.sum("rows_seen").alias("total")
    )
    # one row per field: the rows without f
    whole = merged.where("f is null").select("field", F.col("buckets").alias("all_buckets"), "total")
    entries = merged.where("f is not null").select("field", F.col("hi").alias("value_hi"), F.col("lo").alias("value_lo"), F.col("f").alias("count_low"), "spared")
    found = entries.join(F.broadcast(whole), "field").withColumn("count_high", F.col("count_low") + F.col("all_buckets") + F.col("spared"))
    # a quotient, as it is rounded correctly: exactly the share is enough
    return found.where(F.col("count_high") / F.col("total") >= F.lit(support)).select("field", "value_hi", "value_lo", "count_low", "count_high", "total")
