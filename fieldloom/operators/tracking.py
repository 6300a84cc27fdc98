"""Growth of solved points over the grid, frame after frame.

The solver is a function of tables: it gets the active points with their starting
parameters and returns those it has an answer for, with their score. Everything
else is joins: neighbours, extrapolated starts, what is visited, survival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expressions import extrapolate
from fieldloom.runtime import discard, materialise

#: Parameters of a point: displacement and its gradient.
PARAMS = ["u", "v", "du_dx", "du_dy", "dv_dx", "dv_dy"]
#: Rounds after which the tables of single rounds are written as one.
FOLD = 8

Solver = Callable[[DataFrame], DataFrame]


def starts(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points (keys, y, x, u, v) with the parameters of a plain shift."""
    return points.select(*keys, "y", "x", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"), *[F.lit(0.0).alias(c) for c in PARAMS[2:]])


def children(solved: DataFrame, spacing: int, keys: tuple[str, ...]) -> DataFrame:
    """The four neighbours of each point with the parameters extrapolated to them; of several parents the first in the order up, down, left, right."""
    moves = [(-spacing, 0), (spacing, 0), (0, -spacing), (0, spacing)]
    move = F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(moves)])).alias("m")
    u, v = extrapolate([F.col(c) for c in PARAMS], F.col("m.dx"), F.col("m.dy"))
    to = solved.select(*keys, "y", "x", *PARAMS, move).select(*keys, (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "m.way", u.alias("u"), v.alias("v"), *PARAMS[2:])
    first = to.groupBy(*keys, "y", "x").agg(F.min_by(F.struct(*PARAMS), "way").alias("p"))
    return first.select(*keys, "y", "x", "p.*")


def propagate(begin: DataFrame, grid: DataFrame, solve: Solver, spacing: int, cutoff: float = 2.0, jump: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, y, x, parameters, corr and ok of every point that is reached from the points ``begin`` (keys, y, x, parameters).

    All active points are solved at once. A point is accepted if its score is under
    ``cutoff`` and neither displacement is ``jump`` (spacing + 1, where none is
    given) or more from where it started; a point without an answer is not. The
    neighbours in ``grid`` (keys, y, x) of accepted points that no round has seen
    become active; refused points are not tried again. Rounds go on until no point
    is active. They are as many as the longest path of points, whatever the number
    of keys, and each is written.
    """
    at, limit = [*keys, "y", "x"], spacing + 1 if jump is None else jump
    active, done, fresh = materialise(begin.select(*at, *PARAMS), "active"), None, []
    while not active.isEmpty():
        old = active.select(*at, F.col("u").alias("_u"), F.col("v").alias("_v"))
        near = lambda a, b: F.abs(F.col(a) - F.col(b)) < limit
        ok = F.coalesce((F.col("corr") < cutoff) & near("u", "_u") & near("v", "_v"), F.lit(False))
        now = materialise(old.join(solve(active).select(*at, *PARAMS, "corr").hint("merge"), at, "left").select(*at, *PARAMS, "corr", ok.alias("ok")), "solved")
        fresh.append(now)
        seen = done
        for f in fresh:
            seen = f if seen is None else seen.unionByName(f)
        if len(fresh) == FOLD:
            whole = materialise(seen.repartition(*at), "seen")
            discard(done, *fresh)
            done, fresh, seen, now = whole, [], whole, whole.join(active.select(*at).hint("merge"), at, "left_semi")
        more = children(now.where("ok"), spacing, keys).join(grid.select(*at).distinct().hint("merge"), at, "left_semi").join(seen.select(*at).hint("merge"), at, "left_anti")
        active = materialise(more, "active")
    for f in fresh:
        done = f if done is None else done.unionByName(f)
    return done if done is not None else active.withColumns({"corr": F.lit(None).cast("double"), "ok": F.lit(False)})


def collapsed(solved: DataFrame, grid: DataFrame, keys: tuple[str, ...], least: float) -> DataFrame:
    """The keys of ``grid`` of whose points fewer than the share ``least`` are accepted."""
    total = grid.select(*keys, "y", "x").distinct().groupBy(*keys).agg(F.count("*").alias("_all"))
    valid = solved.where("ok").groupBy(*keys).agg(F.count("*").alias("_ok"))
    return total.join(valid.hint("merge"), list(keys), "left").where(F.coalesce("_ok", F.lit(0)) / F.col("_all") < least).select(*keys)


def track(seeds: DataFrame, grid: DataFrame, solve: Callable[[DataFrame, int], DataFrame], n_frames: int, spacing: int, keys: tuple[str, ...], cutoff: float = 2.0, jump: float | None = None, least: float | None = 0.6) -> DataFrame:
    """frame_idx, keys, y, x, parameters, corr and ok of every point of every frame (0 to n_frames - 1) that is reached.

    ``keys`` name a sequence; all sequences go through a frame at once. The first
    frame grows from the seeds (frame_idx, keys, y, x, u, v). In every later one the
    points that were accepted in the frame before are active from the start with
    their own parameters, and those that failed, or were never reached, can be
    reached again from them. Where fewer than the share ``least`` of a sequence's
    points survive that, its frame is solved again from its seed and that result
    counts; None never does. A sequence without a seed in the frame has no points then.
    """
    out, before = None, None
    for t in range(n_frames):
        begin = starts(seeds.where(F.col("frame_idx") == t), keys)
        grow = lambda points: propagate(points, grid, lambda active: solve(active, t), spacing, cutoff, jump, keys)  # noqa: B023, E731
        if before is None:
            got = grow(begin)
        else:
            got = grow(before.where("ok"))
            if least is not None:
                low = materialise(collapsed(got, grid, keys, least), "collapsed")
                again = grow(begin.join(low.hint("merge"), list(keys), "left_semi"))
                got = got.join(low.hint("merge"), list(keys), "left_anti").unionByName(again)
        before = materialise(got, "frame")
        frame = before.select(F.lit(t).alias("frame_idx"), *keys, "y", "x", *PARAMS, "corr", "ok")
        out = frame if out is None else out.unionByName(frame)
    return out
