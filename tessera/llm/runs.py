"""Running totals over sorted rows, and joins onto keys that many rows share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

_OPS = {"sum": np.add, "xor": np.bitwise_xor}
#: Rows of one key that a shuffled join may bring to one task (or the ten-thousandth part of all rows, if more).
KEY_ROWS = 10_000


def sorted_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Partitions that follow each other by ``by``, each sorted by ``order``."""
    return df.repartitionByRange(*by).sortWithinPartitions(*order)


def _task(key: str, values: dict[str, str]):
    """Running totals within the task, then one row (``_mark``) with the first
    key and the totals of the last one."""

    def run(batches):
        pid = TaskContext.get().partitionId()
        first = last = schema = None
        single = True
        carry = dict.fromkeys(values, 0)
        for b in batches:
            if not b.num_rows:
                continue
            k, schema = b.column(key).to_numpy(), b.schema
            starts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1]
            lengths = np.diff(np.r_[starts, len(k)])
            goes_on = last is not None and k[0] == last
            first = k[0] if first is None else first
            single &= len(starts) == 1 and (last is None or goes_on)
            done = []
            for c, how in values.items():
                op = _OPS[how]
                acc = op.accumulate(b.column(c).to_numpy().astype(np.int64))
                ahead = np.repeat(np.r_[0, acc[starts[1:] - 1]], lengths)
                acc = acc ^ ahead if how == "xor" else acc - ahead
                if goes_on:
                    acc[: lengths[0]] = op(acc[: lengths[0]], carry[c])
                carry[c] = int(acc[-1])
                done.append(pa.array(acc))
            last, n = k[-1], len(k)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *done, pa.array(np.full(n, pid)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.zeros(n, bool))],
                [*b.schema.names, *[f"{c}_upto" for c in values], "_pid", "_first", "_single", "_mark"])
        if schema is not None:
            at = [pa.array([last], f.type) if f.name == key else pa.nulls(1, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(
                [*at, *[pa.array([carry[c]], pa.int64()) for c in values], pa.array([pid], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([single]), pa.array([True])],
                [*schema.names, *[f"{c}_upto" for c in values], "_pid", "_first", "_single", "_mark"])

    return run


def running(df: DataFrame, key: str, values: dict[str, str], tag: str) -> DataFrame:
    """``df`` (from ``sorted_by``, equal ``key`` values next to each other)
    with ``<c>_upto``, the total of ``c`` over the rows of the same key up to
    this one: ``values`` says for each column whether ``sum`` or ``xor``.

    A key may spread over any number of tasks: each task returns its own
    totals, those of the tasks in front (one row a task) are added afterwards.
    """
    cols, names = df.columns, [f"{c}_upto" for c in values]
    extra = ", ".join(f"{c} long" for c in names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {extra}, _pid long, _first long, _single boolean, _mark boolean"
    done = materialize(df.mapInArrow(_task(key, values), schema), tag)
    marks = done.where("_mark").select("_pid", "_first", key, "_single", *names).collect()
    ops = [_OPS[how] for how in values.values()]
    ahead, total, at = [], [0] * len(ops), None
    for pid, first, last, single, *own in sorted(tuple(m) for m in marks):
        front = total if first == at else [0] * len(ops)
        if any(front):
            ahead.append((pid, first, *front))
        total = [int(op(np.int64(a), np.int64(b))) for op, a, b in zip(ops, front, own, strict=True)] if single else own
        at = last
    rows = done.where(~F.col("_mark"))
    if not ahead:
        return rows.select(*cols, *names)
    extra = ", ".join(f"_a{i} long" for i in range(len(ops)))
    front = df.sparkSession.createDataFrame(ahead, f"_pid long, {key} long, {extra}")
    rows = rows.join(F.broadcast(front), ["_pid", key], "left")  # at most one row a task
    for i, (c, how) in enumerate(values.items()):
        a = F.coalesce(f"_a{i}", F.lit(0))
        rows = rows.withColumn(f"{c}_upto", F.col(f"{c}_upto").bitwiseXOR(a) if how == "xor" else F.col(f"{c}_upto") + a)
    return rows.select(*cols, *names)


def looked_up(many: DataFrame, one: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``many`` joined with ``one`` (at most a row a key, null keys match
    none). Keys that more than KEY_ROWS rows (and more than the ten-thousandth
    part of all rows) of ``many`` have, fewer than 10,000 of them, are
    broadcast; the others are shuffled."""
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = max(KEY_ROWS, many.count() // 10_000)
    hot = counts.where(F.col("_n") > most).drop("_n")
    found = materialize(hot.join(one, keys), "hot")
    if found.isEmpty():
        return many.join(one, keys, how)
    heavy = F.broadcast(found)
    return many.join(heavy, keys).unionByName(many.join(heavy, keys, "left_anti").join(one, keys, how))
