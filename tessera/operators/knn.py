"""Multi-column KNN imputation (k nearest donors, nan-Euclidean distance).

For a row with a gap in column c, donors are the rows where c is present.
The distance uses only coordinates present in both rows and is scaled by
(number of columns / number of shared coordinates). The fill is the mean of
c over the k nearest donors (ties broken by donor key); a row that shares
no coordinate with any donor gets the column mean.

Rows are grouped by which columns they lack. Between two such patterns the
shared coordinates are the same for all rows, so the donors of one pattern
are found by an exact nearest-neighbour join (``operators.neighbours``) in
those coordinates; the candidates of all patterns are merged by a window of
at most k rows a pattern. Tables that are small (``FEW_BLOCKS``) or have more
than ``MAX_JOINS`` pairs of patterns compare receivers and donors block by
block instead, with the same result; every task keeps a partial top-k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, nan_as_missing, ref
from tessera.functions.joins import join_shared
from tessera.operators.keys import numbered
from tessera.operators.neighbours import LEAF_ROWS, nearest, smallest
from tessera.operators.pairs import block_pairs

MAX_JOINS = 12   # pairs of gap patterns that are joined one by one
FEW_BLOCKS = 16  # pairs of blocks that are compared at once instead
_SCHEMA = "rid long, ci int, d2 double, dk long, v double"


def _partial_topk(k: int, p: int):
    def fn(rec: pd.DataFrame, don: pd.DataFrame) -> pd.DataFrame:
        out = []
        if rec.empty or don.empty:
            return pd.DataFrame({c: [] for c in ["rid", "ci", "d2", "dk", "v"]})
        R = np.stack(rec["v"].to_numpy()).astype(np.float64)   # NaN = missing
        D = np.stack(don["v"].to_numpy()).astype(np.float64)
        rm, dm = ~np.isnan(R), ~np.isnan(D)
        # exact differences (no dot-product expansion: ties must stay exact),
        # in receiver chunks so that memory stays near 16M cells
        d2 = np.empty((len(R), len(D)))
        step = max(1, (1 << 24) // max(1, len(D) * p))
        for s0 in range(0, len(R), step):
            diff = R[s0:s0 + step, None, :] - D[None, :, :]
            both = ~np.isnan(diff)
            sq = np.where(both, diff * diff, 0.0).sum(-1)
            shared = both.sum(-1)
            with np.errstate(divide="ignore", invalid="ignore"):
                d2[s0:s0 + step] = np.where(shared > 0, sq * (p / np.maximum(shared, 1)), np.nan)
        rids = rec["rid"].to_numpy()
        dks = don["dk"].to_numpy()
        for ci in range(p):
            recv = np.flatnonzero(~rm[:, ci])
            donors = np.flatnonzero(dm[:, ci])
            if len(recv) == 0 or len(donors) == 0:
                continue
            donors = donors[np.argsort(dks[donors], kind="stable")]  # key order breaks distance ties
            sub = d2[np.ix_(recv, donors)]
            sub = np.where(np.isnan(sub), np.inf, sub)
            kk = min(k, len(donors))
            order = smallest(sub, kk)
            dist = np.take_along_axis(sub, order, axis=1)
            ok = np.isfinite(dist)
            if not ok.any():
                continue
            rr, cc = np.nonzero(ok)
            sel = donors[order[rr, cc]]
            out.append(pd.DataFrame({"rid": rids[recv[rr]], "ci": ci, "d2": dist[rr, cc],
                                     "dk": dks[sel], "v": D[sel, ci]}))
        if not out:
            return pd.DataFrame({c: [] for c in ["rid", "ci", "d2", "dk", "v"]})
        return pd.concat(out, ignore_index=True)
    return fn


def _by_blocks(base: DataFrame, donors: DataFrame, k: int, p: int, block_rows: int, receivers: int, rows: int) -> DataFrame:
    """Candidates by comparing every receiver with every donor, block by block."""
    rec = base.where("gap").select(F.col("id").alias("rid"), "v", F.col("id"))
    don = donors.select(F.col("id").alias("dk"), "v", F.col("id"))
    return block_pairs(rec, don, _partial_topk(k, p), _SCHEMA, block_rows, left_rows=receivers, right_rows=rows)


def _pattern_pairs(masks: list[tuple[int, ...]], p: int):
    """(gaps of receivers, gaps of donors, columns the donors can fill, shared columns)"""
    for gaps in masks:
        for lacking in masks:
            wanted = [i for i in gaps if i not in lacking]
            shared = [i for i in range(p) if i not in gaps and i not in lacking]
            if wanted and shared:
                yield gaps, lacking, wanted, shared


def _by_pattern(base: DataFrame, donors: DataFrame, pairs: list, k: int, p: int, leaf_rows: int) -> DataFrame | None:
    """Candidates by one nearest-neighbour join for each pair of a receivers'
    and a donors' pattern of gaps: between them the distance uses the same
    coordinates for all rows, so it is an ordinary distance in those."""
    out = None

    def rows_of(rows: DataFrame, mask: tuple[int, ...], shared: list[int]) -> DataFrame:
        here = F.lit(True)
        for i in range(p):
            here = here & (F.isnan(F.col("v")[i]) if i in mask else ~F.isnan(F.col("v")[i]))
        return rows.where(here).select("id", F.array(*[F.col("v")[i] for i in shared]).alias("x"))

    for gaps, lacking, wanted, shared in pairs:
        near = nearest(rows_of(base, gaps, shared), rows_of(donors, lacking, shared), k, leaf_rows=leaf_rows)
        values = donors.select(F.col("id").alias("nb"), "v")
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("ci"), F.col("v")[i].alias("v")) for i in wanted]))
        got = join_shared(near, values, ["nb"]).select(
            F.col("id").alias("rid"), (F.col("d2") * F.lit(p / len(shared))).alias("d2"), F.col("nb").alias("dk"), each.alias("c"))
        got = got.select("rid", "c.ci", "d2", "dk", "c.v")
        out = got if out is None else out.unionByName(got)
    return out


def donor_table(df: DataFrame, key_cols: list[str], cols: list[str]) -> DataFrame:
    """``id`` and ``cols`` of the rows, for filling gaps of other tables later."""
    frame, key, _ = numbered(nan_as_missing(df), key_cols)
    return frame.select(ref(key).cast("long").alias("id"), *[ref(c).cast("double").alias(c) for c in cols])


def knn_impute(df: DataFrame, key_cols: list[str], cols: list[str], k: int = 5,
               block_rows: int = 2048, leaf_rows: int = LEAF_ROWS, donors: DataFrame | None = None) -> DataFrame:
    """Fill gaps in ``cols`` (doubles) with the mean of the k nearest donors.
    The key may be one column of any type or several; ties go in its order.
    Donors are the rows themselves, or those of ``donors`` (:func:`donor_table`)."""
    names = df.columns
    frame, key, mapping = numbered(nan_as_missing(df), key_cols)
    p = len(cols)
    vec = F.array(*[F.coalesce(ref(c).cast("double"), F.lit(float("nan"))) for c in cols])
    any_gap = F.lit(False)
    for c in cols:
        any_gap = any_gap | ref(c).isNull()
    base = frame.select(ref(key).cast("long").alias("id"), vec.alias("v"), any_gap.alias("gap"))
    given = base if donors is None else donors.select("id", vec.alias("v"))
    value = [F.when(~F.isnan(F.col("v")[i]), F.col("v")[i]) for i in range(p)]
    counts = collect_row(given, F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(value)])
    receivers = base.where("gap").count()
    if receivers == 0:
        return df
    pairs = None
    if p < 63 and math.ceil(receivers / block_rows) * math.ceil(counts["n"] / block_rows) > FEW_BLOCKS:
        mask = sum((F.when(F.isnan(F.col("v")[i]), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(p)), F.lit(0).cast("long"))
        most = 4 * MAX_JOINS
        either = base.select("v") if donors is None else base.select("v").unionByName(given.select("v"))
        bits = [r["m"] for r in either.select(mask.alias("m")).distinct().limit(most + 1).collect()]
        if len(bits) <= most:
            pairs = list(_pattern_pairs([tuple(i for i in range(p) if b >> i & 1) for b in sorted(bits)], p))
    if pairs is not None and len(pairs) <= MAX_JOINS:
        part = _by_pattern(base, given, pairs, k, p, leaf_rows)
    else:
        part = _by_blocks(base, given, k, p, block_rows, receivers, counts["n"])
    sel = []
    if part is not None:
        w = Window.partitionBy("rid", "ci").orderBy("d2", "dk")
        fills = (part.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
                 .groupBy("rid", "ci").agg(F.avg("v").alias("fill")))
        wide = fills.groupBy("rid").agg(*[F.max(F.when(F.col("ci") == i, F.col("fill"))).alias(f"_f{i}")
                                          for i in range(p)])
        frame = frame.join(wide, ref(key).cast("long") == F.col("rid"), "left")
    if mapping is not None:
        frame = frame.join(mapping, key)
    for c in names:
        if c in cols:
            i = cols.index(c)
            filled = [F.col(f"_f{i}")] if part is not None else []
            sel.append(F.coalesce(ref(c).cast("double"), *filled, F.lit(counts[f"m{i}"])).alias(c))
        else:
            sel.append(ref(c))
    return frame.select(*sel)
