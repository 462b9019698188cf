"""Mean shift with a flat kernel: seeds climb to the modes of the density.

Rows with equal features are one weighted unit. Seeds are the centres of the
occupied cells of side ``bandwidth``. In a round every seed that still moves
becomes the mean of the units within ``bandwidth`` of it: an equi-join on the
cells of a two-dimensional grid, an exact distance test, and a sum per seed
that is combined before the shuffle. Seeds that moved less than ``TOLERANCE``
of the bandwidth are settled and leave the loop, which runs over rounds, never
over rows. Few seeds are broadcast, so that the units are not shuffled at
all; many are joined by a shuffle with crowded cells split.

Settled seeds within ``bandwidth`` of a stronger mode (more rows within reach;
then the larger coordinates) belong to it. That greedy choice is made in
rounds as well: a mode stays if it is the strongest undecided one in its
neighbourhood, its neighbours go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import collect_row, sq_dist
from tessera.operators.kmeans import MAX_CENTRE_VALUES, assign
from tessera.operators.neighbours import nearest
from tessera.operators.pairs import _salts, eps_join, grid_axes, vector_dim
from tessera.session import ensure_checkpoint_dir

TOLERANCE = 1e-3
#: Rows of the table of seeds by cell that may be broadcast.
BROADCAST_ROWS = 200_000
CELL_ROWS = 20_000


def _cell(v: Column, side: float) -> Column:
    return F.floor(v / F.lit(float(side))).cast("long")


def bin_seeds(units: DataFrame, bandwidth: float, min_bin: int = 1) -> DataFrame:
    """``(id, x)``: centres of the cells (rounded coordinates) that hold at least ``min_bin`` rows."""
    cells = units.groupBy(F.transform("x", lambda v: F.round(v / F.lit(float(bandwidth))) + F.lit(0.0)).alias("cell")).agg(F.sum("w").alias("w"))
    centres = cells.where(F.col("w") >= min_bin).select(F.transform("cell", lambda v: v * F.lit(float(bandwidth))).alias("x"))
    return centres.select(F.monotonically_increasing_id().alias("id"), "x")


def _reached(seeds: DataFrame, cells: DataFrame, bandwidth: float, dim: int, axes: list[int], salted, few: bool) -> DataFrame:
    """``(id, x, to, n)``: every seed with the mean of the units within reach
    and their number; seeds with none are left out."""
    steps = [(i, j) for i in (-1, 0, 1) for j in ((-1, 0, 1) if len(axes) > 1 else (0,))]
    near = F.explode(F.array(*[F.struct((_cell(F.col("x")[axes[0]], bandwidth) + i).alias("cx"), (
        _cell(F.col("x")[axes[1]], bandwidth) + j if len(axes) > 1 else F.lit(0).cast("long")).alias("cy")) for i, j in steps])).alias("c")
    asked = seeds.select("id", F.col("x").alias("sx"), near).select("id", "sx", "c.cx", "c.cy")
    if few:
        met = cells.drop("salt").join(F.broadcast(asked), ["cx", "cy"])
    else:
        asked = salted(asked).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        met = cells.join(asked, ["cx", "cy", "salt"])
    met = met.where(sq_dist("x", "sx", dim) <= F.lit(float(bandwidth) ** 2))
    sums = met.groupBy("id").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * F.col("x")[i]).alias(f"s{i}") for i in range(dim)])
    to = F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dim)])
    return (F.broadcast(seeds) if few else seeds).join(sums, "id").select("id", "x", to.alias("to"), F.col("n").cast("long").alias("n"))


def settle(units: DataFrame, seeds: DataFrame, bandwidth: float, max_iter: int = 300) -> DataFrame:
    """``(id, x, n)``: where the seeds come to rest, and the rows within reach
    there. Seeds without a row in reach vanish."""
    dim = vector_dim(units)
    axes = grid_axes(units, dim)
    cells = units.select("x", "w", _cell(F.col("x")[axes[0]], bandwidth).alias("cx"), (
        _cell(F.col("x")[axes[1]], bandwidth) if len(axes) > 1 else F.lit(0).cast("long")).alias("cy"))
    salted = _salts(cells, CELL_ROWS)
    cells = salted(cells).withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int")).drop("salts").checkpoint(eager=True)
    done, moving = None, seeds
    n = seeds.count()
    for left in range(max_iter, 0, -1):
        step = _reached(moving, cells, bandwidth, dim, axes, salted, 9 * n <= BROADCAST_ROWS).withColumn("moved", sq_dist("x", "to", dim)).checkpoint(eager=True)
        rests = (F.col("moved") <= F.lit((TOLERANCE * bandwidth) ** 2)) | F.lit(left == 1)
        at_rest = step.where(rests).select("id", F.col("to").alias("x"), "n")
        done = at_rest if done is None else done.unionByName(at_rest)
        moving = step.where(~rests).select("id", F.col("to").alias("x"))
        n = moving.count()
        if not n:
            break
    return done


def strongest(modes: DataFrame, bandwidth: float) -> DataFrame:
    """``(id, x, n)``: of modes within ``bandwidth`` of each other the strongest.
    Modes that came to rest in one cell of a hundredth of the bandwidth count
    as one before that."""
    fine = F.transform("x", lambda v: F.round(v / F.lit(bandwidth / 100)) + F.lit(0.0))
    modes = modes.groupBy(fine.alias("_c")).agg(F.max(F.struct("n", "x", "id")).alias("m")).select("m.id", "m.x", "m.n").checkpoint(eager=True)
    links = eps_join(modes, bandwidth).select("i", "j")
    rank = F.struct("n", "x", "id")
    both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).checkpoint(eager=True)
    kept, left = None, modes
    while not left.isEmpty():
        mine = left.select(F.col("id").alias("i"), rank.alias("ri"))
        theirs = left.select(F.col("id").alias("j"), rank.alias("rj"))
        beaten = both.join(mine, "i").join(theirs, "j").where("rj > ri").select(F.col("i").alias("id")).distinct()
        wins = left.join(beaten, "id", "left_anti").checkpoint(eager=True)
        kept = wins if kept is None else kept.unionByName(wins)
        near = both.join(wins.select(F.col("id").alias("i")), "i").select(F.col("j").alias("id")).distinct()
        left = left.join(wins.select("id"), "id", "left_anti").join(near, "id", "left_anti").checkpoint(eager=True)
    return modes if kept is None else kept


def modes(df: DataFrame, bandwidth: float, min_bin: int = 1, max_iter: int = 300, x: str = "x") -> DataFrame:
    """``(id, x, n)``: the modes of the rows' density and how many rows lie
    within ``bandwidth`` of each."""
    if not bandwidth > 0:
        raise ValueError("bandwidth must be positive")
    ensure_checkpoint_dir(df.sparkSession)
    units = (df.select(F.col(x).cast("array<double>").alias("x")).where("x is not null")
             .groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w")).checkpoint(eager=True))
    if units.isEmpty():
        return df.sparkSession.createDataFrame([], "id long, x array<double>, n long")
    seeds = bin_seeds(units, bandwidth, min_bin).checkpoint(eager=True)
    if seeds.isEmpty():
        raise ValueError(f"no cell of side {bandwidth} holds {min_bin} rows")
    return strongest(settle(units, seeds, bandwidth, max_iter), bandwidth)


def mean_shift(df: DataFrame, key: str, bandwidth: float, min_bin: int = 1, max_iter: int = 300, x: str = "x") -> DataFrame:
    """``(key, cluster)``: every row's nearest mode, numbered by smallest key.
    Rows without features (null) are left out."""
    rows = df.select(F.col(key).alias("id"), F.col(x).cast("array<double>").alias("x")).where("x is not null")
    found = modes(df, bandwidth, min_bin, max_iter, x).orderBy("x").select("x").checkpoint(eager=True)
    n = found.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, cluster int")
    if n * vector_dim(found) <= MAX_CENTRE_VALUES:
        centres = sorted([r["x"] for r in found.collect()])
        near = assign(rows, centres, "x", "_m").select("id", "_m")
    else:
        points = found.select(F.monotonically_increasing_id().alias("id"), "x").checkpoint(eager=True)
        near = nearest(rows, points, 1).select("id", F.col("nb").alias("_m"))
    near = near.checkpoint(eager=True)
    first = near.groupBy("_m").agg(F.min("id").alias("_first"))
    from tessera.operators.graph import dense_index
    number = dense_index(first, "_first", out="cluster")
    return near.join(first.join(number, "_first").select("_m", "cluster"), "_m").select(F.col("id").alias(key), F.col("cluster").cast("int").alias("cluster"))


def estimate_bandwidth(df: DataFrame, key: str, k: int, x: str = "x") -> float | None:
    """Mean distance of the rows to their k-th nearest other row."""
    from tessera.operators.neighbours import k_distance
    return collect_row(k_distance(df, key, k, x), F.avg("k_distance").alias("m"))["m"]
