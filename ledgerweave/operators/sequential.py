"""Folds over rows in order, key by key, that hold one key's state and no rows.

Rows are dealt by key and sorted within partitions, so a key with very many
rows is streamed; it takes one task's time but not its memory.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema


def in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """_key, _first, _last, _rows: df in compressed runs of rows, dealt by key and in order; `runs` reads them.

    For few keys with very many rows each: rows are sorted in ranges of (key,
    order) by many tasks, and a key's one task only puts runs in order, so it
    doesn't hold or spill the rows as Spark's sort would.
    """
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kinds = dict(df.dtypes)

    def pack(batches):
        for batch in batches:
            keys = batch.column(key).to_pylist()
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            for start, end in zip([0, *ends], ends):
                if start == end:
                    continue
                run, sink = batch.slice(start, end - start), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(run)
                at = run.column(order)
                yield pa.record_batch([run.column(key).slice(0, 1), at.slice(0, 1), at.slice(len(at) - 1, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_key", "_first", "_last", "_rows"])

    packed = df.repartitionByRange(n, key, order).sortWithinPartitions(key, order).mapInArrow(pack, f"_key {kinds[key]}, _first {kinds[order]}, _last {kinds[order]}, _rows binary")
    # of runs that begin alike only the last one can end later
    return packed.repartition(n, "_key").sortWithinPartitions("_key", "_first", "_last")


def runs(batches):
    """The rows that `in_order` has packed, a batch per run."""
    for batch in batches:
        for rows in batch.column("_rows"):
            yield from pa.ipc.open_stream(rows.as_buffer())


def fold(df: DataFrame, key: str, order: str, columns: list[str], out: str, start: Callable, step: Callable, opening: DataFrame | None = None, few: bool = False) -> DataFrame:
    """key, order and the columns of `out` for every row.

    start(first row's values) gives a key's state; step(state, values) changes
    it and returns the row's values of `out`.  values are those of `columns`.
    opening(key, ...): a key's state is that of its row there, which comes first
    and gives no row itself, and a key without one gives none; so state is
    loaded in the same exchange, without a join.  few: keys are few and large
    (see in_order).
    """
    kept = df.select(key, order, *[c for c in columns if c not in (key, order)])
    sort = [key, order]
    if opening is not None:
        kept = kept.withColumn("_opens", F.lit(False)).unionByName(opening.withColumn("_opens", F.lit(True)), allowMissingColumns=True)
        sort = [key, F.desc("_opens"), order]
    given, new = kept.select(key, order).schema, StructType.fromDDL(out)
    schema = StructType([*given.fields, *new.fields])
    arrow = to_arrow_schema(schema)
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    loads = opening is not None

    def made(keys, orders, rows):
        cols = list(zip(*rows)) or [()] * len(new.fields)
        return pa.record_batch([keys, orders, *(pa.array(c, arrow.field(i + 2).type) for i, c in enumerate(cols))], schema=arrow)

    def run(batches):
        last, state, begun = None, None, False
        for batch in runs(batches) if few else batches:
            rows = []
            keys, orders = batch.column(key), batch.column(order)
            if loads:
                own = []
                for k, opens, *values in zip(keys.to_pylist(), batch.column("_opens").to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                    if opens:
                        last, state, begun = k, start(*values), True
                    own.append(not opens and begun and k == last)
                    if own[-1]:
                        rows.append(step(state, *values))
                mask = pa.array(own, pa.bool_())
                yield made(keys.filter(mask), orders.filter(mask), rows)
                continue
            for k, *values in zip(keys.to_pylist(), *(batch.column(c).to_pylist() for c in columns)):
                if not begun or k != last:
                    last, state, begun = k, start(*values), True
                rows.append(step(state, *values))
            yield made(keys, orders, rows)

    if few:
        return in_order(kept, key, order).mapInArrow(run, schema)
    return kept.repartition(n, key).sortWithinPartitions(*sort).mapInArrow(run, schema)
