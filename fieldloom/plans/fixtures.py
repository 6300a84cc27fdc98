"""Fields, images, masks and manifests that queries derive from the given tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import masks

N_FRAMES, FPS, RADIUS, SPACING = 28, 2.0, 6, 3
SIDE, SEARCH = 48, 8
POLYGON = [(5, 5), (40, 8), (44, 30), (20, 44)]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def disp(spark: SparkSession, d: str) -> DataFrame:
    """frame_idx, y, x, u, v of the displacement field, with holes."""
    ship = F.col("l_shipdate")
    li = read(spark, d, "lineitem").select(((F.year(ship) - 1995) * 4 + F.quarter(ship) - 1).cast("int").alias("frame_idx"), (F.col("l_suppkey") % 20).cast("int").alias("yi"), (F.col("l_partkey") % 24).cast("int").alias("xi"), "l_quantity", "l_linenumber")
    sums = li.groupBy("frame_idx", "yi", "xi").agg(F.sum("l_quantity").alias("u"), F.sum("l_linenumber").cast("double").alias("v"))
    full = sums.where((7 * F.col("frame_idx") + 3 * F.col("xi") + 5 * F.col("yi")) % 11 != 0)
    return full.select("frame_idx", (3 * F.col("yi")).alias("y"), (3 * F.col("xi")).alias("x"), "u", "v")


DISP = """disp AS (SELECT f AS frame_idx, 3 * yi AS y, 3 * xi AS x, u, v FROM (
  SELECT CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS f, CAST(l_suppkey % 20 AS INTEGER) AS yi, CAST(l_partkey % 24 AS INTEGER) AS xi,
         sum(l_quantity) AS u, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY ALL) WHERE (7 * f + 3 * xi + 5 * yi) % 11 <> 0)"""
DENSE = DISP + """,
frames AS (SELECT CAST(range AS INTEGER) AS frame_idx FROM range(28)), pts AS (SELECT DISTINCT y, x FROM disp),
dense AS (SELECT f.frame_idx, p.y, p.x, d.u, d.v FROM frames f CROSS JOIN pts p LEFT JOIN disp d ON d.frame_idx = f.frame_idx AND d.y = p.y AND d.x = p.x)"""


def diff_sql(c: str) -> str:
    return f"CASE WHEN frame_idx = 0 THEN (lead({c}) OVER t - {c}) / 0.5 WHEN frame_idx = 27 THEN ({c} - lag({c}) OVER t) / 0.5 ELSE (lead({c}) OVER t - lag({c}) OVER t) / 1.0 END"


VEL = DENSE + f""",
vel AS (SELECT *, {diff_sql('u')} AS "Vx", {diff_sql('v')} AS "Vy" FROM dense WINDOW t AS (PARTITION BY y, x ORDER BY frame_idx))"""
EFF = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL AND {2} IS NOT NULL THEN sqrt(greatest(2.0 / 3.0 * ({0} * {0} + {1} * {1} + 2.0 * {2} * {2} - {0} * {1}), 0.0)) END"


def fit_sql(source: str, a: str, b: str, out: str) -> str:
    """CTEs that fit planes to columns a and b of ``source`` on the complete lattice."""
    cols = {"n": "w", "sx": "w * x", "sy": "w * y", "sxx": "w * x * x", "syy": "w * y * y", "sxy": "w * x * y"}
    for k, c in (("a", a), ("b", b)):
        cols |= {f"s{k}": f'CASE WHEN w > 0 THEN "{c}" ELSE 0 END', f"sx{k}": f'CASE WHEN w > 0 THEN "{c}" * x ELSE 0 END', f"sy{k}": f'CASE WHEN w > 0 THEN "{c}" * y ELSE 0 END'}
    one = ", ".join(f"sum({v}) OVER c AS m_{k}" for k, v in cols.items())
    two = ", ".join(f"sum(m_{k}) OVER r AS {k}" for k in cols)
    slope = lambda k, p, q: f"CASE WHEN w > 0 AND n >= 6 AND cxx * cyy - cxy * cxy > 1e-12 THEN ((s{p}{k} - s{k} * s{p} / n) * c{q}{q} - (s{q}{k} - s{k} * s{q} / n) * cxy) / (cxx * cyy - cxy * cxy) END"
    return f""",
box AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM {source}),
grid AS (SELECT f.frame_idx, CAST(gy.range AS INTEGER) AS y, CAST(gx.range AS INTEGER) AS x FROM (SELECT DISTINCT frame_idx FROM {source}) f, box, range(0, 100, 3) gy, range(0, 100, 3) gx WHERE gy.range BETWEEN y0 AND y1 AND gx.range BETWEEN x0 AND x1),
lat AS (SELECT g.frame_idx, g.y, g.x, s.* EXCLUDE (frame_idx, y, x), CASE WHEN s."{a}" IS NOT NULL AND s."{b}" IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS w FROM grid g LEFT JOIN {source} s ON s.frame_idx = g.frame_idx AND s.y = g.y AND s.x = g.x),
pa AS (SELECT *, {one} FROM lat WINDOW c AS (PARTITION BY frame_idx, x ORDER BY y RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
pb AS (SELECT * EXCLUDE ({", ".join(f"m_{k}" for k in cols)}), {two} FROM pa WINDOW r AS (PARTITION BY frame_idx, y ORDER BY x RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
pc AS (SELECT *, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy FROM pb),
{out} AS (SELECT *, {slope('a', 'x', 'y')} AS "d{a}_dx", {slope('a', 'y', 'x')} AS "d{a}_dy", {slope('b', 'x', 'y')} AS "d{b}_dx", {slope('b', 'y', 'x')} AS "d{b}_dy" FROM pc)"""


RATE = VEL + fit_sql("vel", "Vx", "Vy", "fit") + """,
rate AS (SELECT *, "dVx_dx" AS "Exx_rate", "dVy_dy" AS "Eyy_rate", 0.5 * ("dVx_dy" + "dVy_dx") AS "Exy_rate", """ + EFF.format('"dVx_dx"', '"dVy_dy"', '(0.5 * ("dVx_dy" + "dVy_dx"))') + """ AS "Eeff_rate" FROM fit)"""


def trapz_sql(c: str) -> str:
    return f'CASE WHEN frame_idx = 0 THEN 0.0 ELSE 0.5 * (coalesce(lag("{c}_rate") OVER t, 0) + coalesce("{c}_rate", 0)) * 0.5 END AS p_{c}'


STRAIN = RATE + f""",
part AS (SELECT r.*, {", ".join(trapz_sql(c) for c in ("Exx", "Eyy", "Exy"))} FROM rate r JOIN pts p ON p.y = r.y AND p.x = r.x WINDOW t AS (PARTITION BY r.y, r.x ORDER BY r.frame_idx)),
run AS (SELECT *, {", ".join(f'CASE WHEN u IS NOT NULL THEN sum(p_{c}) OVER (PARTITION BY y, x ORDER BY frame_idx) END AS "{c}"' for c in ("Exx", "Eyy", "Exy"))} FROM part),
strain AS (SELECT *, {EFF.format('"Exx"', '"Eyy"', '"Exy"')} AS "Eeff" FROM run)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Sets of four images, each from 58 rows of ``embeddings``: frame 4 s is the reference of set s, and in frames
    4 s + k (k = 1..3) everything has moved by u = k, v = 2 k. Rows after the last full 58 make no image."""
    high = SIDE + 10
    rows = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / high).cast("int").alias("set"), F.pmod("vec_id", F.lit(high)).cast("int").alias("row"), "embedding")
    full = rows.groupBy("set").agg(F.collect_list(F.struct("row", "embedding")).alias("rows")).where(F.size("rows") == high)
    cells = full.select("set", F.explode("rows").alias("r")).select("set", "r.row", F.posexplode("r.embedding").alias("col", "e"))
    base = cells.select("set", "row", "col", F.floor((F.col("e").cast("double") + 0.6) * 200).cast("double").alias("val"))
    moved = base.select("set", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "row", "col", "val")
    out = moved.select((4 * F.col("set") + F.col("k")).alias("frame_id"), (F.col("row") - 10 + 2 * F.col("k")).alias("y"), (F.col("col") - 8 + F.col("k")).alias("x"), "val")
    return out.where(F.col("y").between(0, SIDE - 1) & F.col("x").between(0, SIDE - 1))


def references(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).where("frame_id % 4 = 0")


PIXEL = """px AS (SELECT (4 * e.s + k.k)::INTEGER AS frame_id, (e.r - 10 + 2 * k.k)::INTEGER AS y, (c.c - 8 + k.k)::INTEGER AS x, floor((CAST(e.embedding[c.c + 1] AS DOUBLE) + 0.6) * 200) AS val
  FROM (SELECT vec_id // 58 AS s, vec_id % 58 AS r, embedding FROM embeddings WHERE vec_id // 58 IN (SELECT vec_id // 58 FROM embeddings GROUP BY 1 HAVING count(*) = 58)) e, range(64) c(c), range(4) k(k)
  WHERE e.r - 10 + 2 * k.k BETWEEN 0 AND 47 AND c.c - 8 + k.k BETWEEN 0 AND 47)"""
FULL = "img AS (SELECT a.range::INTEGER AS y, b.range::INTEGER AS x FROM range(48) a, range(48) b)"
RECT = FULL + ", rect AS (SELECT * FROM img WHERE y BETWEEN 4 AND 43 AND x BETWEEN 6 AND 41)"
CIRCLE = FULL + ", circle AS (SELECT * FROM img WHERE (x - 24) * (x - 24) + (y - 24) * (y - 24) <= 225)"
GRID = RECT + ", grid AS (SELECT ((y - 5) // 3)::INTEGER AS iy, ((x - 5) // 3)::INTEGER AS ix, y, x FROM rect WHERE y >= 5 AND y < 43 AND x >= 5 AND x < 43 AND (y - 5) % 3 = 0 AND (x - 5) % 3 = 0)"


def rect(spark: SparkSession) -> DataFrame:
    return masks.roi_rect(spark, SIDE, SIDE, 6, 4, 42, 44)


def circle(spark: SparkSession) -> DataFrame:
    return masks.roi_circle(spark, SIDE, SIDE, 24, 24, 15)


def bright(spark: SparkSession, d: str) -> DataFrame:
    """A rough mask for each reference image: its pixels of code 125 or more."""
    return references(spark, d).where("val >= 125").select("frame_id", "y", "x")


BRIGHT = PIXEL + ", " + FULL + ", bright AS (SELECT frame_id, y, x FROM px WHERE frame_id % 4 = 0 AND val >= 125), imgf AS (SELECT f.frame_id, i.y, i.x FROM (SELECT DISTINCT frame_id FROM bright) f, img i)"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(F.col("url").alias("path"))
