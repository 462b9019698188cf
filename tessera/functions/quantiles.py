"""Exact quantiles (linear interpolation between order statistics) at any size.

Selection by counting. One scan builds a mergeable quantile sketch of every
column (``percentile_approx``, whose rank error is at most n / ACCURACY) and
reads from it two values that enclose each wanted rank. A second scan counts
the rows below, at and between the two values, a third brings back the few in
between, among which the exact order statistic is picked. Where a column is so
long that there are more than ``LIMIT`` rows in between, the range is
narrowed by a sketch of those rows first. No row is shuffled or written; each
task returns a sketch, a few counts and at most ``LIMIT`` values a quantile.

Values that repeat are counted, not collected, so a value held by a third of
the rows costs nothing. Columns of up to ``LIMIT`` values are brought back as
they are.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, ref

ACCURACY = 10_000
LIMIT = 20_000
COLUMNS_PER_JOB = 24
TARGETS_PER_JOB = 72
_INF = float("inf")


def _value(c: str) -> Column:
    """The column as double; NaN is missing, like NULL."""
    x = ref(c).cast("double")
    return F.when(~F.isnan(x), x)


def _interpolate(n: int, p: float, at: dict[int, float]) -> float:
    h = (n - 1) * p
    lo, hi = int(math.floor(h)), int(math.ceil(h))
    if at[lo] == at[hi]:
        return at[lo]
    return at[lo] + (h - lo) * (at[hi] - at[lo])


@dataclass
class _Target:
    """The ranks of one quantile of one column (and group), known to lie
    between the values ``lo`` and ``hi``, with at most ``most`` rows strictly between."""

    ranks: list[int]
    lo: float
    hi: float
    most: float
    found: dict[int, float]

    def done(self) -> bool:
        return len(self.found) == len(self.ranks)


def _bracket_probs(p: float) -> list[float]:
    """Probabilities whose sketched values enclose the ranks of ``p``."""
    return [max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)]


def _target(p: float, n: int, lo: float, hi: float) -> _Target:
    h = (n - 1) * p
    ranks = sorted({int(math.floor(h)), int(math.ceil(h))})
    if n <= LIMIT:
        return _Target(ranks, -_INF, _INF, n, {})
    lo = -_INF if p - 2 / ACCURACY <= 0 else lo
    hi = _INF if p + 2 / ACCURACY >= 1 else hi
    return _Target(ranks, lo, hi, 8 * n / ACCURACY + 16, {})


def _sketch(v: Column, probs: list[float]) -> Column:
    return F.percentile_approx(v, F.array(*[F.lit(float(q)) for q in probs]), F.lit(ACCURACY))


def _inside(v: Column, lo, hi) -> Column:
    return (v > lo) & (v < hi)


def _counts(v: Column, lo, hi) -> Column:
    """Rows below and at ``lo``, and between (plain counts: compiled code)."""
    return F.struct(F.count(F.when(v < lo, 1)).alias("below"), F.count(F.when(v == lo, 1)).alias("at"), F.count(F.when(_inside(v, lo, hi), 1)).alias("inside"))


def _counted(v: Column, lo: Column, hi: Column, collect: Column) -> Column:
    """The same with (sorted) the values between where ``collect``, for groups."""
    some = F.array_sort(F.collect_list(F.when(_inside(v, lo, hi) & collect, v)))
    return F.struct(F.count(F.when(v < lo, 1)).alias("below"), F.count(F.when(v == lo, 1)).alias("at"),
                    F.count(F.when(_inside(v, lo, hi), 1)).alias("inside"), some.alias("some"))


def _between(df: DataFrame, targets: dict) -> dict:
    """The sorted values strictly inside each target's range: one list a
    column of the values inside any of its ranges, which are few."""
    ranges: dict[str, Column] = {}
    for (c, _), t in targets.items():
        inside = _inside(_value(c), F.lit(t.lo), F.lit(t.hi))
        ranges[c] = ranges[c] | inside if c in ranges else inside
    if not ranges:
        return {}
    row = collect_row(df, *[F.collect_list(F.when(inside, _value(c))).alias(f"v{i}") for i, (c, inside) in enumerate(ranges.items())])
    values = {c: sorted(row[f"v{i}"]) for i, c in enumerate(ranges)}
    return {k: values[k[0]][bisect.bisect_right(values[k[0]], t.lo): bisect.bisect_left(values[k[0]], t.hi)] for k, t in targets.items()}


def _settle(t: _Target, row, some) -> list[float] | None:
    """Take what the counts decide; else the relative ranks (0 to 1) to sketch next."""
    first = row["below"] + row["at"]
    wanted = []
    for r in t.ranks:
        if row["below"] <= r < first:
            t.found[r] = t.lo
        elif r >= first + row["inside"]:
            t.found[r] = t.hi
        elif some:
            t.found[r] = some[r - first]
        elif r >= first:
            wanted.append((r - first) / max(1, row["inside"] - 1))
        else:
            raise RuntimeError("a quantile lies outside its sketched range: did the input change between scans?")
    return wanted or None


# ------------------------------------------------------------- whole table

def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact linear quantiles for several columns; None for a column without values."""
    out: dict[str, list[float] | None] = {}
    for lo in range(0, len(cols), COLUMNS_PER_JOB):
        out.update(_selected(df, cols[lo: lo + COLUMNS_PER_JOB], probs))
    return out


def _selected(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    edges = [q for p in probs for q in _bracket_probs(p)]
    first = collect_row(df, *[F.struct(F.count(_value(c)).alias("n"), _sketch(_value(c), edges).alias("q")).alias(f"c{i}")
                              for i, c in enumerate(cols)])
    n = {c: first[f"c{i}"]["n"] for i, c in enumerate(cols)}
    targets = {(c, j): _target(p, n[c], *first[f"c{i}"]["q"][2 * j: 2 * j + 2])
               for i, c in enumerate(cols) if n[c] for j, p in enumerate(probs)}
    while open_ := dict([(k, t) for k, t in targets.items() if not t.done()][:TARGETS_PER_JOB]):
        row = collect_row(df, *[_counts(_value(c), F.lit(t.lo), F.lit(t.hi)).alias(f"t{i}") for i, ((c, _), t) in enumerate(open_.items())])
        narrow, near = {}, {}
        for i, (k, t) in enumerate(open_.items()):
            wanted = _settle(t, row[f"t{i}"], None)
            if wanted and t.most <= LIMIT:
                near[k] = (t, row[f"t{i}"])
            elif wanted:
                narrow[k] = (t, wanted, row[f"t{i}"]["inside"])
        some = _between(df, {k: t for k, (t, _) in near.items()})
        for k, (t, counts) in near.items():
            _settle(t, counts, some[k])
        if narrow:  # more rows in between than may be collected: a sketch of those
            inside = [F.when((_value(c) > F.lit(t.lo)) & (_value(c) < F.lit(t.hi)), _value(c)) for (c, _), (t, _, _) in narrow.items()]
            asked = [[max(0.0, min(w) - 2 / ACCURACY), min(1.0, max(w) + 2 / ACCURACY)] for _, w, _ in narrow.values()]
            row = collect_row(df, *[_sketch(v, q).alias(f"s{i}") for i, (v, q) in enumerate(zip(inside, asked, strict=True))])
            for i, ((t, w, m), q) in enumerate(zip(narrow.values(), asked, strict=True)):
                a, b = row[f"s{i}"]
                t.lo, t.hi = (t.lo if q[0] <= 0 else a), (t.hi if q[1] >= 1 else b)
                t.most = 8 * m / ACCURACY + 16
    return {c: [_interpolate(n[c], p, targets[c, j].found) for j, p in enumerate(probs)] if n[c] else None for c in cols}


# ------------------------------------------------------------------ grouped

def grouped_quantiles(df: DataFrame, group: str, cols: list[str], probs: list[float]) -> dict[tuple, list[float] | None]:
    """Exact linear quantiles per (group value, column): the same selection,
    with one sketch and one pair of values a group. Keys: (group, column).
    Results and sketched values are bounded by the number of groups."""
    out: dict[tuple, list[float] | None] = {}
    for lo in range(0, len(cols), COLUMNS_PER_JOB):
        out.update(_selected_by_group(df, group, cols[lo: lo + COLUMNS_PER_JOB], probs))
    return out


def _selected_by_group(df: DataFrame, group: str, cols: list[str], probs: list[float]) -> dict[tuple, list[float] | None]:
    edges = [q for p in probs for q in _bracket_probs(p)]
    rows = df.select(ref(group).alias("_g"), *[_value(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    values = [F.col(f"_v{i}") for i in range(len(cols))]
    first = rows.groupBy("_g").agg(*[F.struct(F.count(v).alias("n"), _sketch(v, edges).alias("q")).alias(f"c{i}") for i, v in enumerate(values)]).collect()
    n = {(r["_g"], i): r[f"c{i}"]["n"] for r in first for i in range(len(cols))}
    places = [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    targets = {(r["_g"], i, j): _target(probs[j], n[r["_g"], i], *r[f"c{i}"]["q"][2 * j: 2 * j + 2])
               for r in first for i, j in places if n[r["_g"], i]}
    schema = f"_g {dict(rows.dtypes)['_g']}, " + ", ".join(f"l{i}_{j} double, h{i}_{j} double, k{i}_{j} boolean" for i, j in places)
    while True:
        groups = {g for (g, _, _), t in targets.items() if not t.done()}
        if not groups:
            break
        ranges = [(g, *[v for i, j in places for v in _range_of(targets.get((g, i, j)))]) for g in groups]
        near = df.sparkSession.createDataFrame(ranges, schema).withColumnRenamed("_g", "_g2")
        joined = rows.join(F.broadcast(near), rows["_g"].eqNullSafe(near["_g2"]))  # one row a group
        counts = joined.groupBy("_g").agg(*[
            _counted(values[i], F.col(f"l{i}_{j}"), F.col(f"h{i}_{j}"), F.col(f"k{i}_{j}")).alias(f"t{i}_{j}") for i, j in places]).collect()
        narrow = {}
        for r in counts:
            for i, j in places:
                t = targets.get((r["_g"], i, j))
                if t is not None and not t.done():
                    wanted = _settle(t, r[f"t{i}_{j}"], r[f"t{i}_{j}"]["some"])
                    if wanted:
                        narrow[r["_g"], i, j] = (t, wanted, r[f"t{i}_{j}"]["inside"])
        if narrow:
            steps = [k / 64 for k in range(65)]  # relative ranks differ by group: an even grid around them
            sketches = joined.groupBy("_g").agg(*[
                _sketch(F.when((values[i] > F.col(f"l{i}_{j}")) & (values[i] < F.col(f"h{i}_{j}")), values[i]), steps).alias(f"s{i}_{j}")
                for i, j in places]).collect()
            for r in sketches:
                for i, j in places:
                    if (r["_g"], i, j) in narrow:
                        t, w, m = narrow[r["_g"], i, j]
                        a, b = math.floor((min(w) - 2 / ACCURACY) * 64), math.ceil((max(w) + 2 / ACCURACY) * 64)
                        t.lo, t.hi = (t.lo if a <= 0 else r[f"s{i}_{j}"][a]), (t.hi if b >= 64 else r[f"s{i}_{j}"][b])
                        t.most = m * (b - a) / 64 + 8 * m / ACCURACY + 16
    return {(r["_g"], c): [_interpolate(n[r["_g"], i], p, targets[r["_g"], i, j].found) for j, p in enumerate(probs)] if n[r["_g"], i] else None
            for r in first for i, c in enumerate(cols)}


def _range_of(t: _Target | None) -> tuple:
    return (None, None, False) if t is None or t.done() else (t.lo, t.hi, t.most <= LIMIT)
