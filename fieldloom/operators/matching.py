"""Matching between a reference and deformed images, on pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldloom.operators.patches import TILE, folded, over_tiles, readers, tile_arrays, tile_lines
from fieldloom.runtime import materialise, ship, sized


def score_maps(templates: np.ndarray, image: np.ndarray, zero_mean: bool) -> np.ndarray:
    """The score of each template (all of one shape) at every place of the image where it fits: template, row, column."""
    k, th, tw = templates.shape
    flat, n = templates.reshape(k, -1), th * tw
    seen = np.lib.stride_tricks.sliding_window_view(image, (th, tw))
    tt, st = (flat * flat).sum(axis=1), flat.sum(axis=1)
    out = np.empty((k, *seen.shape[:2]))
    band = max(1, BAND // (seen.shape[1] * max(n, k)))
    for top in range(0, len(seen), band):
        part = seen[top : top + band]
        windows = part.reshape(-1, n)
        ti, ii, ss = flat @ windows.T, (windows * windows).sum(axis=1), tt
        if zero_mean:
            si = windows.sum(axis=1)
            ti, ii, ss = ti - np.outer(st, si) / n, ii - si * si / n, tt - st * st / n
        both = np.outer(ss, ii)
        score = np.where(both > 0, ti / np.sqrt(np.where(both > 0, both, 1.0)), 0.0)
        out[:, top : top + band] = np.round(score, 9).reshape(k, *part.shape[:2])
    return out


#: Numbers in the windows of an image that are laid out at once.
BAND = 1 << 20
#: Least side of a template.
LEAST_SIDE = 3


def template_match(seeds: DataFrame, ref: DataFrame, cur: DataFrame, r: int, search: int, h: int, w: int, zero_mean: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, frame_id, id, u0, v0, score of each seed (id, y, x and, where given, a guess gu, gv) in each frame.

    ``ref`` holds one image of h x w pixels for each value of ``keys``, ``cur`` any number of
    frames for each. The template is the square of radius r clipped to the image; it
    is tried at every place in the window of ``search`` pixels more around the seed moved by its guess
    (rounded half to even), clipped as well. The first best score counts: normalised cross correlation, of
    deviations from the mean where ``zero_mean`` says so. A template with a side
    under 3, or a window smaller than it, gives the guess and a score of 0.

    What is found depends on the seed's place and on the one that its guess moves it to, so
    each such pair is matched once and the seeds read the answer. Templates are cut
    out once for each place and image, and meet frames in the tiles that they are
    moved to, in lists of a bounded length, so that work is dealt by frame, tile and list.
    What is found in a batch of tiles is sorted by place and guess: so the same ids
    come again for each frame, and the result (seeds times frames) packs well where it is written.
    """
    spark = ref.sparkSession
    ship(spark)
    group = list(keys)
    guess = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in seeds.columns else F.lit(0.0) for c in ("gu", "gv")}
    box = seeds.select("id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), guess["gu"].alias("gu"), guess["gv"].alias("gv"))
    clip = lambda c, n: F.least(F.greatest(c, F.lit(0)), F.lit(n))
    box = box.withColumns({"r1": clip(F.col("y") - r, h), "r2": clip(F.col("y") + r + 1, h), "c1": clip(F.col("x") - r, w), "c2": clip(F.col("x") + r + 1, w), "ty": F.rint(F.col("y") + F.col("gv")).cast("int"), "tx": F.rint(F.col("x") + F.col("gu")).cast("int")})
    box = box.withColumns({"s1": clip(F.col("ty") - r - search, h), "s2": clip(F.col("ty") + r + search + 1, h), "q1": clip(F.col("tx") - r - search, w), "q2": clip(F.col("tx") + r + search + 1, w)})
    fits = (F.col("r2") - F.col("r1") >= LEAST_SIDE) & (F.col("c2") - F.col("c1") >= LEAST_SIDE) & (F.col("s2") - F.col("s1") >= F.col("r2") - F.col("r1")) & (F.col("q2") - F.col("q1") >= F.col("c2") - F.col("c1"))
    box = materialise(box.withColumn("fits", fits), "seeds")
    frames = materialise(cur.select(*group, "frame_id").distinct(), "frames")
    pair = ["y", "x", "ty", "tx"]
    # The windows of a place (their middles), by the tile that they are searched in: at most as many as the tile has pixels.
    tile = lambda c, n: (F.floor(clip(F.col(c), n - 1) / F.lit(TILE)) * TILE).cast("int")
    sought = box.where("fits").select("r1", "r2", "c1", "c2", "y", "x", "ty", "tx", tile("ty", h).alias("at_y"), tile("tx", w).alias("at_x")).distinct()
    windows = materialise(sought.groupBy("y", "x", "r1", "r2", "c1", "c2", "at_y", "at_x").agg(F.flatten(F.collect_list(F.array("ty", "tx"))).alias("windows")), "windows")
    places = windows.select("y", "x", "r1", "r2", "c1", "c2").distinct()
    each = places.join(sized(materialise(ref.select(*group).distinct(), "images")), F.lit(True)) if group else places

    held = over_tiles(each, tile_arrays(ref, keys, h, w, r), keys, clip(F.col("y"), h - 1), clip(F.col("x"), w - 1))
    line = lambda p: lambda y: F.slice("cells", ((y - F.col("y0")) * F.col("width") + p["c1"] - F.col("x0") + 1).cast("int"), p["c2"] - p["c1"])
    cut = F.transform("points", lambda p: F.struct(*[p[c].alias(c) for c in (*group, "y", "x")], F.flatten(F.transform(F.sequence(p["r1"], p["r2"] - 1), line(p))).alias("t")))
    templates = materialise(held.select(F.explode(cut).alias("p")).select("p.*"), "templates")
    asked = templates.join(windows.hint("merge"), ["y", "x"])
    asked = asked.join(sized(frames), group) if group else asked.join(sized(frames), F.lit(True))
    kinds = {k: cur.schema[k].dataType.simpleString() for k in (*group, "frame_id")}
    blocks = over_tiles(asked, tile_arrays(cur, (*keys, "frame_id"), h, w, r + search), (*keys, "frame_id"), F.col("at_y"), F.col("at_x"))

    def windows_of(middles: np.ndarray) -> np.ndarray:
        """ty, tx and the ends s1, s2 (rows) and q1, q2 (columns) of each window."""
        ty, tx = np.asarray(middles, dtype=np.int64).reshape(-1, 2).T
        ends = [np.clip(c + d, 0, n) for c, n in ((ty, h), (tx, w)) for d in (-r - search, r + search + 1)]
        return np.array([ty, tx, *ends]).T

    def kernel(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tables:
            rows = []
            for block in pdf.itertuples(index=False):
                if block.cells is None:
                    continue
                image, held = np.asarray(block.cells).reshape(-1, block.width), [getattr(block, k) for k in kinds]
                shapes: dict[tuple[int, int], list] = {}
                for p in block.points:
                    shapes.setdefault((p["r2"] - p["r1"], p["c2"] - p["c1"]), []).append(p)
                for (th, tw), points in shapes.items():
                    sought = [windows_of(p["windows"]) for p in points]
                    _, _, s1, s2, q1, q2 = np.concatenate(sought).T
                    top, left = int(s1.min()), int(q1.min())
                    seen = image[top - block.y0 : s2.max() - block.y0, left - block.x0 : q2.max() - block.x0]
                    maps = score_maps(np.array([p["t"] for p in points]).reshape(-1, th, tw), seen, zero_mean)
                    for p, score, wanted in zip(points, maps, sought, strict=True):
                        for ty, tx, s1, s2, q1, q2 in wanted.tolist():
                            part = score[s1 - top : s2 - top - th + 1, q1 - left : q2 - left - tw + 1]
                            row, column = divmod(int(part.argmax()), part.shape[1])
                            rows.append((*held, p["y"], p["x"], ty, tx, float(q1 + column - p["c1"]), float(s1 + row - p["r1"]), float(part[row, column])))
            yield pd.DataFrame(rows, columns=[*kinds, *pair, "u0", "v0", "score"]).sort_values(pair, kind="stable", ignore_index=True)

    shape = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", y int, x int, ty int, tx int, u0 double, v0 double, score double"
    found = blocks.select(*group, "frame_id", "y0", "x0", "width", "cells", "points").mapInPandas(kernel, shape)
    # Every seed is told every frame: that is the result's size.
    out = found.join(readers(box.where("fits").select("id", *pair), pair), pair).select(*kinds, F.explode("points").alias("p"), "u0", "v0", "score").select(*kinds, "p.id", "u0", "v0", "score")
    small = box.where("not fits").select("id", F.col("gu").alias("u0"), F.col("gv").alias("v0")).repartition(spark.sparkContext.defaultParallelism)
    rest = small.join(sized(frames), F.lit(True)).select(*kinds, "id", "u0", "v0", F.lit(0.0).alias("score"))
    return out.unionByName(rest)


#: Entries of the upper half of the normal matrix: a product of gradients (gx gx, gx gy, gy gy) and a monomial of the offsets.
NORMAL = {
    "00": ("a", "1"), "01": ("b", "1"), "02": ("a", "x"), "03": ("a", "y"), "04": ("b", "x"), "05": ("b", "y"),
    "11": ("c", "1"), "12": ("b", "x"), "13": ("b", "y"), "14": ("c", "x"), "15": ("c", "y"),
    "22": ("a", "xx"), "23": ("a", "xy"), "24": ("b", "xx"), "25": ("b", "xy"),
    "33": ("a", "yy"), "34": ("b", "xy"), "35": ("b", "yy"), "44": ("c", "xx"), "45": ("c", "xy"), "55": ("c", "yy"),
}
#: A pivot under this share of its diagonal entry counts as none.
LEAST_PIVOT = 1e-12


def with_pivots(rows: DataFrame, size: int = 6) -> DataFrame:
    """``rows`` with the pivots p0, p1, ... of the symmetric matrix h00, h01, ...; NULL from the first that is not positive."""
    kept = [c for c in rows.columns]
    now = rows.withColumns({f"_{i}{j}": F.col(f"h{i}{j}") for i in range(size) for j in range(i, size)})
    for k in range(size):
        at = [(i, j) for i in range(k + 1, size) for j in range(i, size)]
        now = now.withColumn(f"p{k}", F.when(F.col(f"_{k}{k}") > LEAST_PIVOT * F.col(f"h{k}{k}"), F.col(f"_{k}{k}")))
        now = now.select(*kept, *[f"p{i}" for i in range(k + 1)], *[(F.col(f"_{i}{j}") - F.col(f"_{k}{i}") * F.col(f"_{k}{j}") / F.col(f"p{k}")).alias(f"_{i}{j}") for i, j in at])
    return now


def subset_quality(grid: DataFrame, ref: DataFrame, r: int, h: int, w: int, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """keys, y, x, n_px, sigma, h00 to h55, logdet and valid of the disc around every grid point (keys, y, x), clipped to the image.

    sigma is the root of the summed squared deviations; h is the normal matrix of
    the six parameters, of gradients gx, gy of ``ref`` (keys, y, x, val, gx, gy) over
    sigma. A subset is valid if it has 6 pixels, sigma is at least 1e-12 and all
    pivots of the matrix are positive; logdet is the log of its determinant then.
    Images are read as tiles with a halo of r pixels, and the sums of the points of a list are
    taken together; a pixel that the image lacks takes no part.
    """
    ship(grid.sparkSession)
    spots = grid.select(*keys, "y", "x").distinct()
    ref = ref.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in ("val", "gx", "gy")])
    inside = lambda c, n: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1))
    held = over_tiles(spots, tile_lines(ref, keys, h, w, r, ["val", "gx", "gy"]), keys, inside("y", h), inside("x", w)).select("ty", "tx", "lines", "points")
    shape = StructType([*spots.schema.fields, *[StructField(c, DoubleType()) for c in SUMS]])
    columns, side = spots.columns, TILE + 2 * r

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, lines = batch.column("points"), batch.column("lines")
            flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            y, x = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x"))
            found = np.empty((len(SUMS), len(flat)))
            for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                y0, x0 = (batch.column(c)[i].as_py() * TILE - r for c in ("ty", "tx"))
                line = lines[i].values.field("cells")
                pixel = line.flatten()
                at = np.repeat(lines[i].values.field("y").to_numpy(zero_copy_only=False), pc.list_value_length(line).to_numpy(zero_copy_only=False)) - y0, pixel.field("x").to_numpy(zero_copy_only=False) - x0
                image = np.zeros((4, side, side))
                image[(0, *at)] = 1.0
                for k, c in enumerate(("val", "gx", "gy"), 1):
                    image[(k, *at)] = pixel.field(c).fill_null(0.0).to_numpy(zero_copy_only=False)
                found[:, start:end] = subset_sums(image, y[start:end] - y0, x[start:end] - x0, r)
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in columns], *map(pa.array, found)], names=[*columns, *SUMS])

    got = held.mapInArrow(kernel, shape).where("n > 0")
    square = F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    over = F.when((F.col("n") >= 6) & (square >= 1e-24), square)
    rows = with_pivots(got.select(*keys, "y", "x", F.col("n").cast("long").alias("n_px"), F.sqrt(square).alias("sigma"), *[(F.col(f"{p}_{m}") / over).alias(f"h{e}") for e, (p, m) in NORMAL.items()]))
    logdet = sum((F.log(f"p{k}") for k in range(1, 6)), F.log("p0"))
    return rows.select(*keys, "y", "x", "n_px", "sigma", *[f"h{e}" for e in NORMAL], logdet.alias("logdet"), logdet.isNotNull().alias("valid"))


#: Sums over a subset: pixels, values, squares, and the products of gradients times the monomials of the offsets.
MONOMIALS = ("1", "x", "y", "xx", "xy", "yy")
SUMS = ("n", "s", "ss", *[f"{p}_{m}" for p in "abc" for m in MONOMIALS])


def subset_sums(image: np.ndarray, y: np.ndarray, x: np.ndarray, r: int) -> np.ndarray:
    """``SUMS`` of the discs of radius r around the points, of an image of four layers: 1 where a pixel is, val, gx and gy (else 0)."""
    side = np.arange(-r, r + 1.0)
    dy, dx = (d[side[:, None] ** 2 + side**2 <= r * r] for d in np.meshgrid(side, side, indexing="ij"))
    monomials = np.array([np.ones(len(dx)), dx, dy, dx * dx, dx * dy, dy * dy]).T
    _, height, width = image.shape
    cells = np.concatenate([image.reshape(4, -1), np.zeros((4, 1))], axis=1)
    out, step = np.empty((len(SUMS), len(y))), max(1, BAND // (4 * len(dx)))
    for k in range(0, len(y), step):
        ys, xs = y[k : k + step, None] + dy.astype(int), x[k : k + step, None] + dx.astype(int)
        on = (ys >= 0) & (ys < height) & (xs >= 0) & (xs < width)
        n, val, gx, gy = cells[:, np.where(on, ys * width + xs, height * width)]
        out[:3, k : k + step] = n.sum(axis=1), val.sum(axis=1), (val * val).sum(axis=1)
        out[3:, k : k + step] = np.concatenate([(product @ monomials).T for product in (gx * gx, gx * gy, gy * gy)])
    return out


def coarse_search(points: DataFrame, ref: DataFrame, cur: DataFrame, r: int, h: int, w: int, ref_keys: tuple[str, ...], keys: tuple[str, ...], search: int = 3) -> DataFrame:
    """``points`` (keys, y, x, u, v, ...) with u and v moved by the whole shift of at most ``search`` pixels whose score is least, and that score.

    The score is the squared distance of the normalised zero-mean subsets: the disc
    of radius r around the point in ``ref`` (ref_keys, some of keys) and the disc
    around (y + v, x + u) in ``cur`` (keys), bilinear, borders mirrored. Of equal
    scores the first in the order of the shift along x, then y, counts. A subset of
    one value scores as if its deviations were zero. Images are read as tiles, the
    points of a list together; a point whose tile lacks pixels stays, without a score.
    """
    ship(points.sparkSession)
    reach, columns = r + search, points.columns
    disc = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]

    places = points.select(*ref_keys, "y", "x").distinct()
    at = lambda p, y, x, dy, dx: F.get(F.col("cells"), ((p[y] - F.col("y0") + dy) * F.col("width") + p[x] - F.col("x0") + dx).cast("int"))
    held = over_tiles(places, tile_arrays(ref, ref_keys, h, w, r), ref_keys, F.col("y"), F.col("x"))
    template = held.select(*ref_keys, F.explode(F.transform("points", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"), F.array(*[at(p, "y", "x", dy, dx) for dy, dx in disc]).alias("_f")))).alias("p"))
    template = template.select(*ref_keys, "p.y", "p.x", "p._f").withColumn("_m", F.aggregate("_f", F.lit(0.0), lambda a, v: a + v) / float(len(disc)))
    template = template.withColumn("_c", F.transform("_f", lambda v: v - F.col("_m"))).withColumn("_s", F.greatest(F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e-12)))
    template = template.select(*ref_keys, "y", "x", F.transform("_c", lambda v: v / F.col("_s")).alias("_f"))

    aim = points.withColumns({"_ty": F.col("y") + F.col("v"), "_tx": F.col("x") + F.col("u")}).join(template.hint("merge"), [*ref_keys, "y", "x"])
    whole = lambda c: F.floor(F.col(c))
    aim = aim.withColumns({"_by": F.col("_ty") - whole("_ty"), "_bx": F.col("_tx") - whole("_tx"), "_iy": whole("_ty").cast("int"), "_ix": whole("_tx").cast("int")})
    # A target beyond the image is read where its mirror image lies, and backwards along that axis.
    turned = lambda c, n: F.pmod(F.floor(F.col(c) / F.lit(max(1, n - 1))), F.lit(2)) == 1
    aim = aim.withColumns({"_dy": F.when(turned("_iy", h), -1).otherwise(1), "_dx": F.when(turned("_ix", w), -1).otherwise(1), "_fy": folded(F.col("_iy"), h), "_fx": folded(F.col("_ix"), w)})
    asked = aim.select(*columns, *[F.col(c).cast("double").alias(c) for c in ("_by", "_bx")], *[F.col(c).cast("long").alias(c) for c in ("_dy", "_dx", "_fy", "_fx")], "_f")
    held = over_tiles(asked, tile_arrays(cur, keys, h, w, reach + 1), keys, F.col("_fy"), F.col("_fx")).select("y0", "x0", "width", F.col("cells").cast("array<double>").alias("cells"), "points")
    shape = StructType([*points.schema.fields, *[StructField(c, DoubleType()) for c in ("_sx", "_sy", "score")]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cells = batch.column("points"), batch.column("cells")
            flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            fields = {c: flat.field(c) for c in (*columns, "_by", "_bx", "_dy", "_dx", "_fy", "_fx", "_f")}
            found = np.full((3, len(flat)), np.nan)
            for i, (start, end) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                if not cells[i].is_valid:
                    continue
                of = {c: fields[c].slice(start, end - start) for c in ("_by", "_bx", "_dy", "_dx", "_fy", "_fx", "_f")}
                f = np.asarray(of.pop("_f").flatten()).reshape(-1, len(disc))
                image = np.asarray(cells[i].values).reshape(-1, batch.column("width")[i].as_py())
                spot = {c: of[c].to_numpy(zero_copy_only=False) for c in of}
                spot["_fy"], spot["_fx"] = spot["_fy"] - batch.column("y0")[i].as_py(), spot["_fx"] - batch.column("x0")[i].as_py()
                step = max(1, BAND // (2 * reach + 2) ** 2)
                for k in range(0, end - start, step):
                    found[:, start + k : min(start + k + step, end)] = best_shifts(image, {c: x[k : k + step] for c, x in spot.items()}, f[k : k + step], disc, r, search)
            moved = [pa.array(x, pa.float64(), from_pandas=True) for x in found]
            yield pa.RecordBatch.from_arrays([*[fields[c] for c in columns], *moved], names=[f.name for f in shape])

    found = held.mapInArrow(kernel, shape)
    new = {c: (F.col(c) + F.coalesce(F.col(by), F.lit(0.0))).alias(c) for c, by in (("u", "_sx"), ("v", "_sy"))}
    return found.select(*[new.get(c, F.col(c)) for c in columns], "score")


def best_shifts(image: np.ndarray, spot: dict[str, np.ndarray], f: np.ndarray, disc: list[tuple[int, int]], r: int, search: int) -> np.ndarray:
    """Shift along x and y and score of the first best shift of each point at (_fy + _by, _fx + _bx), with the values f of its subset on ``disc``."""
    reach, n, side = r + search, float(len(disc)), np.arange(-r - search, r + search + 2)
    ys, xs = spot["_fy"][:, None] + spot["_dy"][:, None] * side, spot["_fx"][:, None] + spot["_dx"][:, None] * side
    tap, by, bx = image[ys[:, :, None], xs[:, None, :]], spot["_by"][:, None, None], spot["_bx"][:, None, None]
    g = (1 - by) * ((1 - bx) * tap[:, :-1, :-1] + bx * tap[:, :-1, 1:]) + by * ((1 - bx) * tap[:, 1:, :-1] + bx * tap[:, 1:, 1:])
    dy, dx = np.array(disc).T + reach
    s, ss = f.sum(axis=1), (f * f).sum(axis=1)
    shifts = [(sx, sy) for sx in range(-search, search + 1) for sy in range(-search, search + 1)]
    score = np.empty((len(shifts), len(f)))
    for k, (sx, sy) in enumerate(shifts):
        at = g[:, dy + sy, dx + sx]
        total, both = at.sum(axis=1), (f * at).sum(axis=1)
        squares = np.maximum((at * at).sum(axis=1) - total * total / n, 0.0)
        norm = np.maximum(np.sqrt(squares), 1e-12)
        score[k] = np.round(squares / (norm * norm) - 2 * (both - s * total / n) / norm + ss, 9)
    best = score.argmin(axis=0)
    least = score[best, np.arange(len(f))]
    return np.where(np.isnan(least), np.nan, np.array([*np.array(shifts, dtype=float)[best].T, least]))
