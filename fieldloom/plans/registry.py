"""Registered queries of the field-analytics operators: each a DataFrame job, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import expressions as X
from fieldloom.operators import grid as G
from fieldloom.operators import images as I
from fieldloom.operators import kinematics as K
from fieldloom.operators import masks as R
from fieldloom.operators import matching as C
from fieldloom.operators import splines as P
from fieldloom.operators import stats as A
from fieldloom.operators import tracking as T
from fieldloom.plans import fixtures as fx
from fieldloom.runtime import materialise, new_path, sized
from fieldloom.sources import frames as S
from fieldloom.sources import session

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Masks and grids of images are keyed by their frame.
BY = ("frame_id",)
N, FPS, RAD, SP, SIDE = fx.N_FRAMES, fx.FPS, fx.RADIUS, fx.SPACING, fx.SIDE


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, keys: str, values: str) -> DataFrame:
    """Keys and values rounded to 6 decimals, without negative zero."""
    return df.select(*keys.split(), *[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) for c in values.split()])


def sql(ctes: str, keys: str, values: str, source: str, tail: str = "") -> str:
    cols = [*keys.split(), *[f'round("{c}", 6) + 0.0 AS "{c}"' for c in values.split()]]
    return f"WITH {ctes}\nSELECT {', '.join(cols)} FROM {source} {tail}"


def vel(s: SparkSession, d: str) -> DataFrame:
    return K.velocity(fx.disp(s, d), N, FPS)


def strained(s: SparkSession, d: str) -> DataFrame:
    return K.kinematics(fx.disp(s, d), N, FPS, RAD, SP)


# Sources and sinks ---------------------------------------------------------------------------
query("s1_scan_files")(lambda s, d: S.scan_frames(s, d, ("parquet",)).select(S.base_name(F.col("path")).alias("name")))
FILES = "f AS (SELECT url AS path, row_number() OVER (ORDER BY url) - 1 AS rn FROM pages WHERE lower(list_last(string_split(url, '/'))) NOT LIKE '%roi%')"
query("s3_select_frames", f"WITH {FILES} SELECT path, rn = 0 AS is_reference, CAST(CASE WHEN rn = 0 THEN -1 ELSE (rn - 1) // 3 END AS INTEGER) AS frame_idx FROM f WHERE rn = 0 OR ((rn - 1) % 3 = 0 AND (rn - 1) // 3 < 20)")(lambda s, d: S.select_frames(fx.manifest(s, d), 3, 20))
query("s4_detect_roi", "SELECT max(url) AS roi_path FROM pages WHERE lower(list_last(string_split(url, '/'))) LIKE '%roi%'")(lambda s, d: S.detect_roi(fx.manifest(s, d)))
ORDER_IDX = "SELECT CAST(o_orderkey AS BIGINT) AS idx FROM orders"
query("s5_sample_range", "SELECT o_orderkey AS idx FROM orders WHERE o_orderkey BETWEEN 10 AND 900 AND (o_orderkey - 10) % 7 = 0")(lambda s, d: S.sample_range(fx.read(s, d, "orders").select(F.col("o_orderkey").alias("idx")), 10, 900, 7))
query("s6_split_reference", "WITH f AS (SELECT url AS path, row_number() OVER (ORDER BY url, page_id) - 1 AS idx FROM pages) SELECT path, idx = 5 AS is_reference, CAST(CASE WHEN idx = 5 THEN -1 WHEN idx > 5 THEN idx - 1 ELSE idx END AS INTEGER) AS frame_idx FROM f")(
    lambda s, d: S.split_reference(S.ranked(fx.read(s, d, "pages").select(F.col("url").alias("path"), "page_id"), ["path", "page_id"], "idx"), 5))
query("s7_effective_fps", "SELECT coalesce(max(round(value)), 1.0) / 3 AS fps FROM events")(lambda s, d: S.effective_fps(fx.read(s, d, "events").select(F.round("value").alias("fps")), None, 3))
query("s8_with_time", f"WITH {fx.DISP} SELECT DISTINCT frame_idx, frame_idx / 2.0::DOUBLE AS t_sec FROM disp")(lambda s, d: S.with_time(fx.disp(s, d).select("frame_idx").distinct(), FPS))
query("s9_mask_from_pixels", f"WITH {fx.PIXEL} SELECT frame_id, y, x FROM px p WHERE val > 0.5 * (SELECT max(val) FROM px q WHERE q.frame_id = p.frame_id)")(lambda s, d: I.mask_from_pixels(fx.pixels(s, d)))
query("s11_pick_mask", "WITH c AS (SELECT l_returnflag AS name, CAST(l_linenumber % 2 AS INTEGER) AS val FROM lineitem UNION ALL SELECT l_linestatus, l_linenumber FROM lineitem), g AS (SELECT name, sum(val) AS n FROM c GROUP BY name HAVING bool_and(val IN (0, 1))) SELECT name, CAST(n AS BIGINT) AS n FROM g ORDER BY n DESC, name LIMIT 1")(
    lambda s, d: S.pick_mask(fx.read(s, d, "lineitem").select(F.col("l_returnflag").alias("name"), (F.col("l_linenumber") % 2).alias("val")).union(fx.read(s, d, "lineitem").select("l_linestatus", "l_linenumber"))))


@query("s13_write_mask", f"WITH {fx.BRIGHT} SELECT frame_id, y, x, 255 AS val FROM bright")
def _s13(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "mask")
    session.write_mask(fx.bright(s, d), path, BY)
    return s.read.parquet(path)


query("s14_csv_rows", f"""WITH {fx.DISP} SELECT r.range::INTEGER AS y, string_agg(coalesce(CAST(CAST(d.u AS BIGINT) AS VARCHAR) || '.0', 'nan'), ',' ORDER BY c.range) AS line
FROM range(60) r CROSS JOIN range(72) c LEFT JOIN disp d ON d.frame_idx = 3 AND d.y = r.range AND d.x = c.range GROUP BY r.range""")(lambda s, d: session.csv_rows(fx.disp(s, d), "u", 3, 60, 72))


@query("s15_s16_session", sql(fx.DISP, "frame_idx y x", "u v", "disp").replace("FROM disp", ", CAST(NULL AS DOUBLE) AS corr, 2.0::DOUBLE AS fps FROM disp"))
def _s15(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "session")
    session.write_session(fx.disp(s, d), fx.rect(s), {"fps": FPS}, path)
    meta, _, field = session.read_session(s, path)
    return rounded(field, "frame_idx y x", "u v").withColumns({"corr": F.lit(None).cast("double"), "fps": F.lit(float(meta["fps"]))})


_DIM = ", ".join(f"('{n}', '{q}', '{c}', '{u}')" for q, (u, fields) in session.QUANTITIES.items() for n, c in fields.items())
query("s17_field_catalog", f"WITH {fx.DISP}, dim(name, quantity, component, unit) AS (VALUES {_DIM}), l AS (SELECT frame_idx, y, x, 'u' AS name, u AS value FROM disp UNION ALL SELECT frame_idx, y, x, 'v', v FROM disp) SELECT frame_idx, y, x, name, value, quantity, component, unit FROM l JOIN dim USING (name)")(lambda s, d: session.long_form(fx.disp(s, d)))


# Masks ---------------------------------------------------------------------------------------
query("v1_shapes_agree", f"WITH {fx.PIXEL}, s AS (SELECT frame_id, max(y) AS h, max(x) AS w FROM px GROUP BY frame_id) SELECT count(DISTINCT (h, w)) <= 1 AS same FROM s")(lambda s, d: S.shapes_agree(fx.pixels(s, d).groupBy("frame_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))))
query("v2_valid", f"WITH {fx.DENSE} SELECT frame_idx, y, x FROM dense WHERE u IS NOT NULL")(lambda s, d: K.dense_frames(fx.disp(s, d), N).where(X.finite(F.col("u")).isNotNull()).select("frame_idx", "y", "x"))


def masked(name: str, ctes: str, where: str, mask: Callable[[SparkSession], DataFrame]) -> None:
    """A shape's mask applied to every reference image."""
    query(name, f"WITH {fx.PIXEL}, {ctes} SELECT p.frame_id, p.y, p.x, p.val FROM px p JOIN {where} m ON m.y = p.y AND m.x = p.x WHERE p.frame_id % 4 = 0")(
        lambda s, d: fx.references(s, d).join(sized(mask(s)), ["y", "x"]).select("frame_id", "y", "x", "val"))


masked("r1_full", fx.FULL, "img", lambda s: R.roi_full(s, SIDE, SIDE))
masked("r2_rect", fx.RECT, "rect", fx.rect)
masked("r3_circle", fx.CIRCLE, "circle", fx.circle)
_EDGES = list(zip(fx.POLYGON, fx.POLYGON[1:] + fx.POLYGON[:1], strict=True))
_INSIDE = " + ".join(f"CAST((({y1} > y) <> ({y2} > y)) AND x < {x2 - x1} * (y - {y1})::DOUBLE / {y2 - y1} + {x1} AS INTEGER)" for (x1, y1), (x2, y2) in _EDGES if y1 != y2)
_EDGE = " OR ".join(f"((x - {x1}) * {y2 - y1} = (y - {y1}) * {x2 - x1} AND x BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND y BETWEEN {min(y1, y2)} AND {max(y1, y2)})" for (x1, y1), (x2, y2) in _EDGES)
masked("r4_polygon", fx.FULL + f", poly AS (SELECT * FROM img WHERE ({_INSIDE}) % 2 = 1 OR {_EDGE})", "poly", lambda s: R.roi_polygon(s, SIDE, SIDE, fx.POLYGON))
query("r5_point_in_polygon", f"WITH {fx.DISP}, p AS (SELECT frame_idx, y AS y0, x AS x0, x AS x, y AS y FROM disp) SELECT frame_idx, y, x, ({_INSIDE}) % 2 = 1 AS inside FROM p")(lambda s, d: fx.disp(s, d).select("frame_idx", "y", "x", X.in_polygon(F.col("x"), F.col("y"), fx.POLYGON).alias("inside")))
query("r6_erase", f"WITH {fx.BRIGHT} SELECT frame_id, y, x FROM bright WHERE (x - 24) * (x - 24) + (y - 24) * (y - 24) > 16")(lambda s, d: R.roi_erase(fx.bright(s, d), [(24, 24)], 4))
query("r7_union", f"WITH {fx.BRIGHT}, c AS (SELECT * FROM imgf WHERE (x - 24) * (x - 24) + (y - 24) * (y - 24) <= 225) SELECT frame_id, y, x FROM bright UNION SELECT frame_id, y, x FROM c")(lambda s, d: R.roi_union(fx.bright(s, d), R.roi_of_frames(fx.bright(s, d), SIDE, SIDE, BY).where((F.col("x") - 24) * (F.col("x") - 24) + (F.col("y") - 24) * (F.col("y") - 24) <= 225), BY))
query("r8_border", f"WITH {fx.BRIGHT} SELECT b.frame_id, b.y, b.x FROM bright b LEFT JOIN bright n ON n.frame_id = b.frame_id AND abs(n.y - b.y) + abs(n.x - b.x) = 1 GROUP BY ALL HAVING count(n.y) < 4")(lambda s, d: R.mask_border(fx.bright(s, d), SIDE, SIDE, BY))
query("r9_dilate", f"WITH {fx.BRIGHT} SELECT DISTINCT b.frame_id, i.y, i.x FROM img i JOIN bright b ON b.y BETWEEN i.y - 2 AND i.y + 1 AND b.x BETWEEN i.x - 2 AND i.x + 1")(lambda s, d: R.mask_dilate(fx.bright(s, d), SIDE, SIDE, R.square(4), BY))
GROUND = "g AS (SELECT frame_id, y, x FROM imgf EXCEPT SELECT frame_id, y, x FROM bright), reach(frame_id, y, x) AS (SELECT frame_id, y, x FROM g WHERE y IN (0, 47) OR x IN (0, 47) UNION SELECT g.frame_id, g.y, g.x FROM reach r JOIN (SELECT range AS o FROM range(4)) o ON true JOIN g ON g.frame_id = r.frame_id AND g.y = r.y + CASE o.o WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END AND g.x = r.x + CASE o.o WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END)"
query("r10_fill_holes", f"WITH RECURSIVE {fx.BRIGHT}, {GROUND} SELECT frame_id, y, x FROM imgf EXCEPT SELECT frame_id, y, x FROM reach")(lambda s, d: R.mask_fill_holes(fx.bright(s, d), SIDE, SIDE, BY))
query("r11_seed_in_roi", f"WITH {fx.BRIGHT} SELECT frame_id, y, x FROM bright WHERE x = 20 AND y = 21")(lambda s, d: R.seed_in_roi((20, 21), fx.bright(s, d)))
query("r12_roi_size", f"WITH {fx.BRIGHT} SELECT frame_id, count(*) AS n_pixels FROM bright GROUP BY frame_id")(lambda s, d: R.roi_size(fx.bright(s, d), BY))
query("r13_grid_count", f"WITH {fx.BRIGHT} SELECT frame_id, count(*) AS n FROM bright WHERE y >= 5 AND y < 43 AND x >= 5 AND x < 43 AND (y - 5) % 3 = 0 AND (x - 5) % 3 = 0 GROUP BY frame_id")(lambda s, d: G.build_grid(fx.bright(s, d), SIDE, SIDE, 5, 3, BY).groupBy("frame_id").agg(F.count("*").alias("n")))
SMALL = "small AS (SELECT frame_idx, y, x, u / 16 AS u, v / 16 AS v FROM disp), bm AS (SELECT frame_id AS frame_idx, y, x FROM px WHERE val >= 110)"
query("r14_dynamic_drop", f"WITH {fx.DISP}, {fx.PIXEL}, {SMALL} SELECT s.* FROM small s WHERE EXISTS (SELECT 1 FROM bm WHERE bm.frame_idx = s.frame_idx AND bm.y = round_even(s.y + s.v, 0) AND bm.x = round_even(s.x + s.u, 0))")(
    lambda s, d: R.apply_dynamic_mask(fx.disp(s, d).withColumns({"u": F.col("u") / 16, "v": F.col("v") / 16}), fx.pixels(s, d).where("val >= 110").select(F.col("frame_id").alias("frame_idx"), "y", "x"), SIDE, SIDE))

# Grid ----------------------------------------------------------------------------------------
BGRID = fx.BRIGHT + ", bgrid AS (SELECT frame_id, ((y - 2) // 2)::INTEGER AS iy, ((x - 2) // 2)::INTEGER AS ix, y, x FROM bright WHERE y >= 2 AND y < 46 AND x >= 2 AND x < 46 AND (y - 2) % 2 = 0 AND (x - 2) % 2 = 0), dom AS (SELECT *, CAST(CASE WHEN count(*) OVER (PARTITION BY frame_id) < 200 THEN 0 ELSE ntile(4) OVER (PARTITION BY frame_id ORDER BY y, x) - 1 END AS INTEGER) AS domain FROM bgrid)"
bgrid = lambda s, d: G.build_grid(fx.bright(s, d), SIDE, SIDE, 2, 2, BY)
domains = lambda s, d: G.assign_domain(bgrid(s, d), 4, BY)
query("g1_build_grid", f"WITH {BGRID} SELECT frame_id, iy, ix, y, x FROM bgrid")(bgrid)
query("g2_disc", f"WITH {fx.PIXEL} SELECT frame_id, y - 20 AS dy, x - 20 AS dx, val FROM px WHERE frame_id % 4 = 0 AND (y - 20) * (y - 20) + (x - 20) * (x - 20) <= 49")(lambda s, d: fx.references(s, d).select("frame_id", (F.col("y") - 20).alias("dy"), (F.col("x") - 20).alias("dx"), "val").join(sized(G.disc_offsets(s, 7)), ["dy", "dx"]))
query("g3_default_seed", f"WITH {fx.BRIGHT} SELECT frame_id, floor(avg(x))::INTEGER AS x, floor(avg(y))::INTEGER AS y FROM bright GROUP BY frame_id")(lambda s, d: G.default_seed(fx.bright(s, d), BY))
query("g4_snap", f"WITH {BGRID}, p AS (SELECT s_suppkey AS id, s_suppkey * 7 % 48 AS py, s_suppkey * 5 % 48 AS px FROM supplier), r AS (SELECT frame_id, id, y, x, row_number() OVER (PARTITION BY frame_id, id ORDER BY (y - py) * (y - py) + (x - px) * (x - px), y, x) AS k FROM p, bgrid) SELECT frame_id, id, y, x FROM r WHERE k = 1")(
    lambda s, d: G.snap(fx.read(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 48).alias("y"), (F.col("s_suppkey") * 5 % 48).alias("x")), bgrid(s, d), BY))
query("g5_assign_domain", f"WITH {BGRID} SELECT * FROM dom")(domains)
query("g6_domain_seeds", f"WITH {BGRID}, c AS (SELECT frame_id, domain, CASE WHEN domain = 0 THEN 12 ELSE avg(y) END AS cy, CASE WHEN domain = 0 THEN 20 ELSE avg(x) END AS cx FROM dom GROUP BY frame_id, domain), r AS (SELECT d.frame_id, d.domain, y, x, row_number() OVER (PARTITION BY d.frame_id, d.domain ORDER BY (y - cy) * (y - cy) + (x - cx) * (x - cx), y, x) AS k FROM dom d JOIN c ON c.frame_id = d.frame_id AND c.domain = d.domain) SELECT frame_id, domain, y, x FROM r WHERE k = 1")(
    lambda s, d: G.domain_seeds(domains(s, d), (20.0, 12.0), BY))
query("g7_neighbours", f"WITH {BGRID} SELECT a.frame_id, a.domain, a.y, a.x, b.y AS ny, b.x AS nx, CASE WHEN b.y < a.y THEN 0 WHEN b.y > a.y THEN 1 WHEN b.x < a.x THEN 2 ELSE 3 END AS direction FROM dom a JOIN dom b ON a.frame_id = b.frame_id AND a.domain = b.domain AND abs(a.y - b.y) + abs(a.x - b.x) = 2 AND (a.y = b.y OR a.x = b.x)")(lambda s, d: G.neighbours(domains(s, d), 2, BY))
query("g8_merge_domains", f"WITH {BGRID} SELECT frame_id, domain, count(*) AS n FROM dom GROUP BY frame_id, domain")(lambda s, d: domains(s, d).where("domain < 2").unionByName(domains(s, d).where("domain >= 2")).groupBy("frame_id", "domain").agg(F.count("*").alias("n")))
query("g9_densify", f"WITH {fx.DISP} SELECT f.frame_idx, r.range::INTEGER AS y, c.range::INTEGER AS x, d.u, d.v FROM (SELECT DISTINCT frame_idx FROM disp) f CROSS JOIN range(60) r CROSS JOIN range(72) c LEFT JOIN disp d ON d.frame_idx = f.frame_idx AND d.y = r.range AND d.x = c.range")(lambda s, d: G.densify(fx.disp(s, d), 60, 72))
CROP = fx.DISP + ", b AS (SELECT frame_idx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM disp GROUP BY frame_idx), crop AS (SELECT b.frame_idx, r.range::INTEGER AS row, c.range::INTEGER AS col, d.u FROM b CROSS JOIN range(40) r CROSS JOIN range(40) c LEFT JOIN disp d ON d.frame_idx = b.frame_idx AND d.y = b.y0 + 3 * r.range AND d.x = b.x0 + 3 * c.range WHERE b.y0 + 3 * r.range <= b.y1 AND b.x0 + 3 * c.range <= b.x1)"
query("g10_crop_decimate", f"WITH {CROP} SELECT * FROM crop")(lambda s, d: G.crop_decimate(fx.disp(s, d), "u", 3))
query("g11_fill_nearest", f"WITH {CROP}, r AS (SELECT a.frame_idx, a.row, a.col, b.u, row_number() OVER (PARTITION BY a.frame_idx, a.row, a.col ORDER BY (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col), b.row, b.col) AS k FROM crop a JOIN crop b ON b.frame_idx = a.frame_idx AND b.u IS NOT NULL) SELECT frame_idx, row, col, u FROM r WHERE k = 1")(lambda s, d: G.fill_nearest(G.crop_decimate(fx.disp(s, d), "u", 3), "u"))

# Images --------------------------------------------------------------------------------------
MIRROR = fx.PIXEL + ", o AS (SELECT range::INTEGER - 4 AS o FROM range(9)), m AS (SELECT range::INTEGER - 4 AS i, CASE WHEN range < 4 THEN 4 - range WHEN range > 51 THEN 98 - range ELSE range - 4 END::INTEGER AS j FROM range(56))"


def conv(name: str, value: str, ky: str, kx: str, source: str = "px") -> str:
    """Separable weighted sum over mirrored neighbours; weights as CASE expressions of o."""
    return f""", {name}_1 AS (SELECT p.frame_id, t.y, p.x, sum(p.{value} * ({ky})) AS s FROM (SELECT y::INTEGER AS y, o FROM range(48) r(y), o) t JOIN m ON m.i = t.y + t.o JOIN {source} p ON p.y = m.j GROUP BY ALL),
{name} AS (SELECT p.frame_id, p.y, t.x, sum(p.s * ({kx})) AS s FROM (SELECT x::INTEGER AS x, o FROM range(48) r(x), o) t JOIN m ON m.i = t.x + t.o JOIN {name}_1 p ON p.x = m.j GROUP BY ALL)"""


ONES, ROW121, DIFF = "1", "CASE abs(o) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END", "CASE o WHEN -1 THEN -1 WHEN 1 THEN 1 ELSE 0 END"
BINOM = "CASE abs(o) WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END"
STD = MIRROR + conv("a1", "val", ONES, ONES) + ", px2 AS (SELECT frame_id, y, x, val * val AS val FROM px)" + conv("a2", "val", ONES, ONES, "px2") + ", sd AS (SELECT a1.frame_id, a1.y, a1.x, sqrt(greatest(a2.s / 81.0 - (a1.s / 81.0) * (a1.s / 81.0), 0.0)) AS val FROM a1 JOIN a2 ON a1.frame_id = a2.frame_id AND a1.y = a2.y AND a1.x = a2.x)"
SOBEL = MIRROR + conv("gx", "val", ROW121, DIFF) + conv("gy", "val", DIFF, ROW121) + ", so AS (SELECT gx.frame_id, gx.y, gx.x, sqrt(gx.s * gx.s + gy.s * gy.s) AS val FROM gx JOIN gy ON gx.frame_id = gy.frame_id AND gx.y = gy.y AND gx.x = gy.x)"
U8 = ", u8 AS (SELECT frame_id, y, x, CASE WHEN max(val) OVER (PARTITION BY frame_id) > 0 THEN floor(val / max(val) OVER (PARTITION BY frame_id) * 255.0) ELSE 0 END::INTEGER AS val FROM {0})"
query("i4_local_std", sql(STD, "frame_id y x", "val", "sd"))(lambda s, d: rounded(I.local_std(fx.pixels(s, d), SIDE, SIDE), "frame_id y x", "val"))
query("i5_sobel", sql(SOBEL, "frame_id y x", "val", "so"))(lambda s, d: rounded(I.sobel(fx.pixels(s, d), SIDE, SIDE), "frame_id y x", "val"))
query("i6_gauss", "WITH " + MIRROR + conv("g", "val", BINOM, BINOM) + " SELECT frame_id, y, x, round_even(s / 256.0, 0) + 0.0 AS val FROM g")(lambda s, d: I.smooth(fx.pixels(s, d), SIDE, SIDE, "gauss"))
query("i7_to_u8", "WITH " + fx.PIXEL + U8.format("px") + " SELECT * FROM u8")(lambda s, d: I.to_u8(fx.pixels(s, d)))
OTSU = U8.format("px") + ", hi AS (SELECT frame_id, val, count(*) AS n FROM u8 GROUP BY ALL), cu AS (SELECT *, sum(n) OVER w AS n0, sum(n * val) OVER w AS s0, sum(n) OVER (PARTITION BY frame_id) AS nn, sum(n * val) OVER (PARTITION BY frame_id) AS ss FROM hi WINDOW w AS (PARTITION BY frame_id ORDER BY val)), be AS (SELECT frame_id, val, CASE WHEN nn > n0 THEN round(n0::DOUBLE * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) * (s0 / n0 - (ss - s0) / (nn - n0)), 6) ELSE 0 END AS b FROM cu), ot AS (SELECT frame_id, val AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY b DESC, val) AS k FROM be) WHERE k = 1)"
query("i8_otsu", "WITH " + fx.PIXEL + OTSU + " SELECT * FROM ot")(lambda s, d: I.otsu(I.to_u8(fx.pixels(s, d))))
ELL = "el AS (SELECT a.range::INTEGER - 7 AS dy, b.range::INTEGER - 7 AS dx FROM range(15) a, range(15) b WHERE abs(b.range - 7) <= round_even(7 * sqrt(1 - (a.range - 7) * (a.range - 7) / 49.0), 0))"
query("i9_close", f"WITH {fx.BRIGHT}, {ELL}, sparse AS (SELECT frame_id, y, x FROM bright WHERE (y * 5 + x * 3) % 7 = 0), di AS (SELECT DISTINCT b.frame_id, b.y - dy AS y, b.x - dx AS x FROM sparse b, el WHERE b.y - dy BETWEEN 0 AND 47 AND b.x - dx BETWEEN 0 AND 47), inside AS (SELECT i.y, i.x, count(*) AS n FROM img i, el WHERE i.y + dy BETWEEN 0 AND 47 AND i.x + dx BETWEEN 0 AND 47 GROUP BY ALL), hit AS (SELECT d.frame_id, d.y - dy AS y, d.x - dx AS x, count(*) AS n FROM di d, el GROUP BY ALL) SELECT h.frame_id, h.y, h.x FROM hit h JOIN inside i ON i.y = h.y AND i.x = h.x AND i.n = h.n")(
    lambda s, d: R.morph_close(fx.bright(s, d).where((F.col("y") * 5 + F.col("x") * 3) % 7 == 0), SIDE, SIDE, 15, BY))
def contour_sql(mask: str) -> str:
    """Least labels of 8-connected pixels and of the 4-connected rest by recursion to the end, holes to the part around them, and areas by unit cells."""
    spread = lambda name, of, near: f"{name}(frame_id, y, x, lab) USING KEY (frame_id, y, x) AS (SELECT frame_id, y, x, y * 48 + x FROM {of} UNION SELECT n.frame_id, n.y, n.x, min(t.lab) FROM {name} t JOIN recurring.{name} n ON n.frame_id = t.frame_id AND abs(n.y - t.y) <= 1 AND abs(n.x - t.x) <= 1 AND {near} AND t.lab < n.lab GROUP BY ALL)"
    return f"""bk AS MATERIALIZED (SELECT i.frame_id, i.y, i.x FROM (SELECT f.frame_id, i.y, i.x FROM (SELECT DISTINCT frame_id FROM {mask}) f, (SELECT a.range::INTEGER AS y, b.range::INTEGER AS x FROM range(48) a, range(48) b) i) i WHERE NOT EXISTS (SELECT 1 FROM {mask} m WHERE m.frame_id = i.frame_id AND m.y = i.y AND m.x = i.x)),
{spread('fg', mask, 'true')}, {spread('bg', 'bk', '(n.y = t.y OR n.x = t.x)')},
ho AS (SELECT * FROM bg WHERE NOT EXISTS (SELECT 1 FROM bg e WHERE e.frame_id = bg.frame_id AND e.lab = bg.lab AND (e.y IN (0, 47) OR e.x IN (0, 47)))),
ow AS (SELECT h.frame_id, h.lab, f.lab AS owner FROM (SELECT DISTINCT frame_id, lab FROM ho) h JOIN fg f ON f.frame_id = h.frame_id AND f.y = h.lab // 48 AND f.x = h.lab % 48 - 1),
fl AS MATERIALIZED (SELECT frame_id, y, x, lab AS owner FROM fg UNION ALL SELECT h.frame_id, h.y, h.x, o.owner FROM ho h JOIN ow o ON o.frame_id = h.frame_id AND o.lab = h.lab),
ce AS (SELECT frame_id, owner, y - a.range AS y, x - b.range AS x, count(*) AS m FROM fl, range(2) a, range(2) b GROUP BY ALL),
ar AS (SELECT frame_id, owner, sum(CASE m WHEN 4 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS n FROM ce GROUP BY ALL),
bs AS (SELECT frame_id, owner FROM (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, owner) AS k FROM ar) WHERE k = 1)
SELECT frame_id, y, x FROM fl JOIN bs USING (frame_id, owner)"""


query("i10_largest_component", f"WITH RECURSIVE {fx.PIXEL}, bright AS MATERIALIZED (SELECT frame_id, y, x FROM px WHERE frame_id % 4 = 0 AND val >= 125), {contour_sql('bright')}")(lambda s, d: R.largest_component(fx.bright(s, d), SIDE, SIDE, BY))
query("i11_dynamic_mask")(lambda s, d: I.dynamic_mask(fx.pixels(s, d), SIDE, SIDE, "Hybrid"))

# Matching ------------------------------------------------------------------------------------
SEEDS = "sd AS (SELECT s_suppkey AS id, (s_suppkey * 7 % 48)::INTEGER AS y, (s_suppkey * 5 % 48)::INTEGER AS x, s_suppkey % 7 * 1.5::DOUBLE - 4.5 AS gu, CASE WHEN s_suppkey % 11 = 0 THEN 70 ELSE s_suppkey % 5 - 2 END::DOUBLE AS gv FROM supplier)"


def seeds(s: SparkSession, d: str) -> DataFrame:
    """Seeds anywhere, borders included, with a guess; that of some lies far outside."""
    key = F.col("s_suppkey")
    return fx.read(s, d, "supplier").select(key.alias("id"), (key * 7 % 48).cast("int").alias("y"), (key * 5 % 48).cast("int").alias("x"), (key % 7 * 1.5 - 4.5).alias("gu"), F.when(key % 11 == 0, 70).otherwise(key % 5 - 2).cast("double").alias("gv"))


def match_sql(score: str) -> str:
    """Images as lists; templates and windows are cut out of them row by row."""
    cut = lambda image, top, bottom, left, width: f"flatten(list_transform(range({top}, {bottom}), j -> {image}[j * 48 + {left} + 1:j * 48 + {left} + {width}]))".replace("j ->", "lambda j:")
    return f"""WITH {fx.PIXEL}, {SEEDS}, im AS MATERIALIZED (SELECT frame_id, list(val ORDER BY y, x) AS im FROM px GROUP BY frame_id),
bx AS (SELECT *, greatest(0, y - 5) AS r1, least(48, y + 6) AS r2, greatest(0, x - 5) AS c1, least(48, x + 6) AS c2, round_even(y + gv, 0)::INTEGER AS ty, round_even(x + gu, 0)::INTEGER AS tx FROM sd),
wi AS (SELECT *, r2 - r1 AS th, c2 - c1 AS tw, greatest(0, ty - 13) AS sr1, least(48, ty + 14) AS sr2, greatest(0, tx - 13) AS sc1, least(48, tx + 14) AS sc2 FROM bx),
tp AS MATERIALIZED (SELECT *, list_sum(t) AS st, list_inner_product(t, t) AS tt, th * tw AS n FROM (SELECT wi.*, im.frame_id AS rf, {cut('im.im', 'r1', 'r2', 'c1', 'tw')} AS t FROM wi, im WHERE im.frame_id % 4 = 0 AND th >= 3 AND tw >= 3 AND sr2 - sr1 >= th AND sc2 - sc1 >= tw)),
pl AS (SELECT *, unnest(range(sr1, sr2 - th + 1)) AS a FROM tp), pm AS (SELECT *, unnest(range(sc1, sc2 - tw + 1)) AS b FROM pl),
ca AS (SELECT *, list_inner_product(t, i) AS ti, list_inner_product(i, i) AS ii, list_sum(i) AS si FROM (SELECT m.*, im.frame_id, {cut('im.im', 'm.a', 'm.a + m.th', 'm.b', 'm.tw')} AS i FROM pm m JOIN im ON im.frame_id // 4 = m.rf // 4 AND im.frame_id % 4 > 0)),
k AS (SELECT frame_id, id, b - c1 AS u0, a - r1 AS v0, a, b, round({score}, 9) AS score FROM ca), r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, id ORDER BY score DESC, a, b) AS rk FROM k)
SELECT f.frame_id, w.id, coalesce(r.u0::DOUBLE, w.gu) AS u0, coalesce(r.v0::DOUBLE, w.gv) AS v0, coalesce(r.score, 0.0) AS score
FROM wi w JOIN (SELECT frame_id FROM im WHERE frame_id % 4 > 0) f ON true LEFT JOIN (SELECT * FROM r WHERE rk = 1) r ON r.frame_id = f.frame_id AND r.id = w.id"""


in_sets = lambda p: p.withColumn("set", F.floor(F.col("frame_id") / 4).cast("int"))


def matched(zero_mean: bool) -> Query:
    return lambda s, d: C.template_match(seeds(s, d), in_sets(fx.references(s, d)).drop("frame_id"), in_sets(fx.pixels(s, d).where("frame_id % 4 > 0")), 5, fx.SEARCH, SIDE, SIDE, zero_mean, ("set",)).drop("set")


query("c1_template_match", match_sql("CASE WHEN tt * ii > 0 THEN ti / sqrt(tt * ii) ELSE 0 END"))(matched(False))
query("c2_zero_mean_match", match_sql("CASE WHEN (tt - st * st / n) * (ii - si * si / n) > 0 THEN (ti - st * si / n) / sqrt((tt - st * st / n) * (ii - si * si / n)) ELSE 0 END"))(matched(True))
WARP = "w AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS u, CAST(embedding[2] AS DOUBLE) * 4 AS v, CAST(embedding[3] AS DOUBLE) / 8 AS ux, CAST(embedding[4] AS DOUBLE) / 8 AS uy, CAST(embedding[5] AS DOUBLE) / 8 AS vx, CAST(embedding[6] AS DOUBLE) / 8 AS vy, CAST(embedding[7] AS DOUBLE) AS du, CAST(embedding[8] AS DOUBLE) AS dv, CAST(embedding[9] AS DOUBLE) / 8 AS dux, CAST(embedding[10] AS DOUBLE) / 8 AS duy, CAST(embedding[11] AS DOUBLE) / 8 AS dvx, CAST(embedding[12] AS DOUBLE) / 8 AS dvy FROM embeddings)"
WNAMES = ("u", "v", "ux", "uy", "vx", "vy", "du", "dv", "dux", "duy", "dvx", "dvy")
WSCALE = (4, 4, 0.125, 0.125, 0.125, 0.125, 1, 1, 0.125, 0.125, 0.125, 0.125)


def warps(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * k).alias(n) for i, (n, k) in enumerate(zip(WNAMES, WSCALE, strict=True))])


OUT = "pu pv pux puy pvx pvy"


@query("c5_compose_affine", sql(WARP + ", i AS (SELECT *, (1 + dux) * (1 + dvy) - duy * dvx AS det FROM w), j AS (SELECT *, (1 + dvy) / det AS ia, -duy / det AS ib, -dvx / det AS ic, (1 + dux) / det AS ie FROM i), k AS (SELECT *, -(ia * du + ib * dv) AS iu, -(ic * du + ie * dv) AS iv FROM j), o AS (SELECT vec_id, (1 + ux) * iu + uy * iv + u AS pu, vx * iu + (1 + vy) * iv + v AS pv, (1 + ux) * ia + uy * ic - 1 AS pux, (1 + ux) * ib + uy * ie AS puy, vx * ia + (1 + vy) * ic AS pvx, vx * ib + (1 + vy) * ie - 1 AS pvy FROM k)", "vec_id", OUT, "o"))
def _c5(s: SparkSession, d: str) -> DataFrame:
    c = [F.col(n) for n in WNAMES]
    return rounded(warps(s, d).select("vec_id", *[x.alias(n) for x, n in zip(X.compose_affine(c[:6], c[6:]), OUT.split(), strict=True)]), "vec_id", OUT)


@query("c6_extrapolate", sql(WARP + ", o AS (SELECT vec_id, u + ux * 3 + uy * -3 AS eu, v + vx * 3 + vy * -3 AS ev FROM w)", "vec_id", "eu ev", "o"))
def _c6(s: SparkSession, d: str) -> DataFrame:
    eu, ev = X.extrapolate([F.col(n) for n in WNAMES[:6]], F.lit(3), F.lit(-3))
    return rounded(warps(s, d).select("vec_id", eu.alias("eu"), ev.alias("ev")), "vec_id", "eu ev")


query("c7_accept", f"WITH {WARP} SELECT vec_id FROM w WHERE abs(ux * 40) < 0.5 AND abs(u - du) < 2 AND abs(v - dv) < 2")(lambda s, d: warps(s, d).where(X.accepted(F.abs(F.col("ux") * 40), F.col("u"), F.col("v"), F.col("du"), F.col("dv"), 1, 0.5)).select("vec_id"))
query("c13_survival", f"WITH {fx.DENSE} SELECT frame_idx, count(u) AS n_valid, count(u) / 480.0::DOUBLE AS survival, count(u) / 480.0::DOUBLE < 0.6 AS redo FROM dense GROUP BY frame_idx")(lambda s, d: A.survival(fx.disp(s, d), 480, N))
query("c14_next_guess", f"WITH {fx.DISP} SELECT frame_idx, median(u) AS u0, median(v) AS v0 FROM disp GROUP BY frame_idx")(lambda s, d: A.next_guess(fx.disp(s, d)))

# Tracking ------------------------------------------------------------------------------------
AT, PAR = "s4, y, x", "u, v, du_dx, du_dy, dv_dx, dv_dy"


def scored(points: DataFrame, image: DataFrame) -> DataFrame:
    """A stand-in for a solver: parameters and score that depend on the start and on the pixel below."""
    c = F.col("val").cast("int")
    new = {"u": F.col("u") + c % 9 - 4, "v": F.col("v") + (c % 5 - 2) / 4.0, **{p: (c % m - 1) / 64.0 for p, m in zip(T.PARAMS[2:], (3, 4, 5, 6), strict=True)}}
    return points.join(image.hint("merge"), ["set", "y", "x"]).withColumns(new).withColumn("corr", (F.col("val") + 5 * F.col("set") % 4 * F.col("k")) / 80.0)


def tracked(s: SparkSession, d: str, n_frames: int, least: float | None) -> DataFrame:
    """Sequences of the deformed images of each set, from the grid point nearest to the middle of the mask."""
    px = materialise(in_sets(fx.pixels(s, d)).select("set", (F.col("frame_id") % 4).alias("k"), "y", "x", "val"), "images")
    grid = materialise(G.build_grid(px.where("k = 0 and val >= 90").select("set", "y", "x"), SIDE, SIDE, 5, 3, ("set",)).select("set", "y", "x"), "grid")
    d2 = (F.col("y") - 24) * (F.col("y") - 24) + (F.col("x") - 24) * (F.col("x") - 24)
    seed = grid.groupBy("set").agg(F.min(F.struct(d2.alias("d2"), "y", "x")).alias("m")).select("set", "m.y", "m.x", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1))).alias("frame_idx"))
    seed = materialise(seed.withColumns({"u": F.col("frame_idx") + 1, "v": 2 * F.col("frame_idx") + 2}), "seeds")
    # The stand-in reads the pixels below grid points only.
    below = [materialise(px.where(F.col("k") == t + 1).join(grid.hint("merge"), ["set", "y", "x"], "left_semi"), "below") for t in range(n_frames)]
    return T.track(seed, grid, lambda active, t: scored(active, below[t]), n_frames, 3, ("set",), least=least)


GROWTH = fx.PIXEL + """, im AS MATERIALIZED (SELECT frame_id // 4 AS s4, frame_id % 4 AS k, y, x, val, val::INTEGER AS c FROM px),
gr AS MATERIALIZED (SELECT s4, y, x FROM im WHERE k = 0 AND val >= 90 AND y BETWEEN 5 AND 42 AND x BETWEEN 5 AND 42 AND (y - 5) % 3 = 0 AND (x - 5) % 3 = 0),
se AS MATERIALIZED (SELECT s4, y, x FROM (SELECT *, row_number() OVER (PARTITION BY s4 ORDER BY (y - 24) * (y - 24) + (x - 24) * (x - 24), y, x) AS r FROM gr) WHERE r = 1)"""


def solved_sql(source: str, k: int) -> str:
    """Points of ``source`` solved on image k of their set."""
    new = [f"q.u + p.c % 9 - 4 AS u, q.v + (p.c % 5 - 2) / 4.0::DOUBLE AS v, (p.c % 3 - 1) / 64.0::DOUBLE AS du_dx, (p.c % 4 - 1) / 64.0::DOUBLE AS du_dy, (p.c % 5 - 1) / 64.0::DOUBLE AS dv_dx, (p.c % 6 - 1) / 64.0::DOUBLE AS dv_dy, (p.val + 5 * q.s4 % 4 * {k}) / 80.0::DOUBLE AS corr"]
    return f"SELECT q.s4, q.y, q.x, {new[0]}, (p.val + 5 * q.s4 % 4 * {k}) / 80.0 < 2 AND abs(p.c % 9 - 4) < 4 AND abs((p.c % 5 - 2) / 4.0) < 4 AS ok FROM ({source}) q JOIN im p ON p.k = {k} AND p.s4 = q.s4 AND p.y = q.y AND p.x = q.x"


def grow_sql(name: str, start: str, k: int) -> str:
    """The recursion from the points ``start`` on image k: the neighbours of accepted points that no round has seen."""
    to = f"SELECT t.s4, t.y + m.dy AS y, t.x + m.dx AS x, arg_min({{'u': t.u + t.du_dx * m.dx + t.du_dy * m.dy, 'v': t.v + t.dv_dx * m.dx + t.dv_dy * m.dy}}, m.way) AS g FROM {name} t, (VALUES (0, -3, 0), (1, 3, 0), (2, 0, -3), (3, 0, 3)) m(way, dy, dx) WHERE t.ok GROUP BY ALL"
    fresh = f"SELECT c.s4, c.y, c.x, c.g.u AS u, c.g.v AS v FROM ({to}) c JOIN gr ON gr.s4 = c.s4 AND gr.y = c.y AND gr.x = c.x WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.s4 = c.s4 AND r.y = c.y AND r.x = c.x)"
    return f"{name}({AT}, {PAR}, corr, ok) USING KEY ({AT}) AS ({solved_sql(start, k)} UNION {solved_sql(fresh, k)})"


def track_sql(n_frames: int, least: float | None) -> str:
    ctes, before = [f"WITH RECURSIVE {GROWTH}"], None
    for k in range(1, n_frames + 1):
        seed = f"SELECT s4, y, x, {k}::DOUBLE AS u, {2 * k}::DOUBLE AS v FROM se"
        ctes.append(grow_sql(f"w{k}", seed if before is None else f"SELECT s4, y, x, u, v FROM {before} WHERE ok", k))
        if before is None or least is None:
            ctes.append(f"f{k} AS MATERIALIZED (SELECT * FROM w{k})")
        else:
            ctes.append(f"low{k} AS MATERIALIZED (SELECT g.s4 FROM (SELECT s4, count(*) AS n FROM gr GROUP BY s4) g LEFT JOIN (SELECT s4, count(*) AS n FROM w{k} WHERE ok GROUP BY s4) w ON w.s4 = g.s4 WHERE coalesce(w.n, 0) / g.n::DOUBLE < {least})")
            ctes.append(grow_sql(f"r{k}", f"SELECT * FROM ({seed}) WHERE s4 IN (SELECT s4 FROM low{k})", k))
            ctes.append(f"f{k} AS MATERIALIZED (SELECT * FROM w{k} WHERE s4 NOT IN (SELECT s4 FROM low{k}) UNION ALL SELECT * FROM r{k})")
        before = f"f{k}"
    out = " UNION ALL ".join(f"SELECT {k - 1}::INTEGER AS frame_idx, s4::INTEGER AS set, y, x, {PAR}, corr, ok FROM f{k}" for k in range(1, n_frames + 1))
    return ",\n".join(ctes) + "\n" + out


query("c9_frontier", track_sql(1, None))(lambda s, d: tracked(s, d, 1, None))
query("c12_warm_start", track_sql(3, None))(lambda s, d: tracked(s, d, 3, None))
query("c13_redo", track_sql(3, 0.6))(lambda s, d: tracked(s, d, 3, 0.6))

# Splines -------------------------------------------------------------------------------------
REFS = fx.PIXEL + ", rf AS MATERIALIZED (SELECT * FROM px WHERE frame_id % 4 = 0)"


def coeff_sql(source: str = "rf") -> str:
    """Spline coefficients as a sum over mirrored neighbours: the closed impulse response of the two poles."""
    z1, z2 = P.POLES
    gain = 120 / ((z1 + 1 / z1) - (z2 + 1 / z2))
    weight = f"({-gain * z1 / (1 - z1 * z1)!r} * power({z1!r}, abs(o)) + {gain * z2 / (1 - z2 * z2)!r} * power({z2!r}, abs(o)))"
    mirror = "mi AS (SELECT i.range::INTEGER AS i, o.range - 40 AS o, CASE WHEN (i.range + o.range - 40 + 94) % 94 > 47 THEN 94 - (i.range + o.range - 40 + 94) % 94 ELSE (i.range + o.range - 40 + 94) % 94 END AS j FROM range(48) i, range(81) o)"
    return f"{mirror}, wt AS (SELECT i, j, sum({weight}) AS w FROM mi GROUP BY ALL), c1 AS (SELECT p.frame_id, t.i AS y, p.x, sum(p.val * t.w) AS val FROM {source} p JOIN wt t ON t.j = p.y GROUP BY ALL), co AS MATERIALIZED (SELECT p.frame_id, p.y, t.i AS x, sum(p.val * t.w) AS val FROM c1 p JOIN wt t ON t.j = p.x GROUP BY ALL)"


COEFF = REFS + ", " + coeff_sql()
coeff = lambda s, d: P.coefficients(fx.references(s, d), SIDE, SIDE)
query("i1_spline_prefilter", sql(COEFF, "frame_id y x", "val", "co"))(lambda s, d: rounded(coeff(s, d), "frame_id y x", "val"))
SPOTS = "sp AS (SELECT frame_id, y * 48 + x AS id, y * 53 // 48 - 3 + (x % 8) / 8.0::DOUBLE AS y, x * 53 // 48 - 3 + (y % 16) / 16.0::DOUBLE AS x FROM rf WHERE (5 * y + 3 * x) % 13 = 0)"


def spots(s: SparkSession, d: str) -> DataFrame:
    """Points off the pixels, some of them beyond the image, in every reference image."""
    y, x = F.col("y"), F.col("x")
    return fx.references(s, d).where((5 * y + 3 * x) % 13 == 0).select("frame_id", (y * 48 + x).alias("id"), (F.floor(y * 53 / 48) - 3 + (x % 8) / 8.0).alias("y"), (F.floor(x * 53 / 48) - 3 + (y % 16) / 16.0).alias("x"))


def beta_sql(d: str) -> str:
    return f"CASE WHEN abs({d}) < 1 THEN (66 - 60 * power({d}, 2) + 30 * power({d}, 4) - 10 * power(abs({d}), 5)) / 120 WHEN abs({d}) < 2 THEN (51 + 75 * abs({d}) - 210 * power({d}, 2) + 150 * power(abs({d}), 3) - 45 * power({d}, 4) + 5 * power(abs({d}), 5)) / 120 WHEN abs({d}) < 3 THEN power(3 - abs({d}), 5) / 120 ELSE 0 END"


def taps_sql(dy: float, dx: float, name: str) -> str:
    """The spline at the points moved by (dy, dx), mirrored by pixel."""
    mirror = lambda e: f"CASE WHEN ({e} + 94) % 94 > 47 THEN 94 - ({e} + 94) % 94 ELSE ({e} + 94) % 94 END"
    ty, tx = f"(p.y + {dy!r} - floor(p.y) - a.range + 3)", f"(p.x + {dx!r} - floor(p.x) - b.range + 3)"
    return f"{name} AS (SELECT p.frame_id, p.id, p.y, p.x, sum(c.val * ({beta_sql(ty)}) * ({beta_sql(tx)})) AS val FROM sp p, range(8) a, range(8) b JOIN co c ON true WHERE c.frame_id = p.frame_id AND c.y = {mirror('(floor(p.y)::INTEGER + a.range - 3)')} AND c.x = {mirror('(floor(p.x)::INTEGER + b.range - 3)')} GROUP BY ALL)"


query("i2_spline_sample", sql(COEFF + ", " + SPOTS + ", " + taps_sql(0.0, 0.0, "va"), "frame_id id y x", "val", "va"))(lambda s, d: rounded(P.sample(spots(s, d), coeff(s, d), SIDE, SIDE).withColumnRenamed("value", "val"), "frame_id id y x", "val"))
_H = P.STEP
GRADS = COEFF + ", " + SPOTS + ", " + ", ".join(taps_sql(dy, dx, n) for n, dy, dx in (("xa", 0.0, _H), ("xb", 0.0, -_H), ("ya", _H, 0.0), ("yb", -_H, 0.0)))
GRADS += f", gd AS (SELECT xa.frame_id, xa.id, xa.y, xa.x, round((xa.val - xb.val) / {2 * _H!r}, 4) AS gx, round((ya.val - yb.val) / {2 * _H!r}, 4) AS gy FROM xa JOIN xb USING (frame_id, id) JOIN ya USING (frame_id, id) JOIN yb USING (frame_id, id))"
query("i3_spline_gradient", sql(GRADS, "frame_id id y x", "gx gy", "gd"))(lambda s, d: rounded(P.gradient_at(spots(s, d), coeff(s, d), SIDE, SIDE).withColumns({c: F.round(c, 4) for c in ("gx", "gy")}), "frame_id id y x", "gx gy"))

# Subsets and the search around a start ---------------------------------------------------------
_VALUE, _SLOPE = P.kernels()
_TAPS = "tp(o, wv, ws) AS (VALUES " + ", ".join(f"({o}, {v!r}::DOUBLE, {d!r}::DOUBLE)" for o, v, d in zip(range(-3, 4), _VALUE, _SLOPE, strict=True)) + ")"
_FOLD = lambda e: f"CASE WHEN ({e} + 94) % 94 > 47 THEN 94 - ({e} + 94) % 94 ELSE ({e} + 94) % 94 END"
SLOPED = COEFF + f", {_TAPS}, ip AS (SELECT i.range::INTEGER AS i, {_FOLD('(i.range + o)')} AS j, wv, ws FROM range(48) i, tp), g1 AS (SELECT c.frame_id, t.i AS y, c.x, sum(c.val * wv) AS v, sum(c.val * ws) AS d FROM co c JOIN ip t ON t.j = c.y GROUP BY ALL), gi AS MATERIALIZED (SELECT g.frame_id, g.y, t.i AS x, sum(g.v * ws) AS gx, sum(g.d * wv) AS gy FROM g1 g JOIN ip t ON t.j = g.x GROUP BY ALL)"
query("i3_image_gradient", sql(SLOPED, "frame_id y x", "gx gy", "gi"))(lambda s, d: rounded(P.image_gradient(coeff(s, d), SIDE, SIDE), "frame_id y x", "gx gy"))
_OFFSETS = {"1": "1", "x": "(p.x - g.x)", "y": "(p.y - g.y)", "xx": "(p.x - g.x) * (p.x - g.x)", "xy": "(p.x - g.x) * (p.y - g.y)", "yy": "(p.y - g.y) * (p.y - g.y)"}
_PRODUCTS = {"a": "i.gx * i.gx", "b": "i.gx * i.gy", "c": "i.gy * i.gy"}
QUALITY = SLOPED + ", gq AS (SELECT frame_id, y, x FROM rf WHERE y BETWEEN 5 AND 42 AND x BETWEEN 6 AND 41 AND (y - 5) % 3 = 0 AND (x - 5) % 3 = 0), q AS (SELECT g.frame_id, g.y, g.x, count(*) AS n_px, sqrt(greatest(sum(p.val * p.val) - sum(p.val) * sum(p.val) / count(*), 0.0)) AS sigma, " + ", ".join(f"sum({_PRODUCTS[p]} * {_OFFSETS[m]}) AS {p}_{m}" for p in _PRODUCTS for m in _OFFSETS) + " FROM gq g JOIN rf p ON p.frame_id = g.frame_id AND p.y BETWEEN g.y - 5 AND g.y + 5 AND p.x BETWEEN g.x - 5 AND g.x + 5 AND (p.y - g.y) * (p.y - g.y) + (p.x - g.x) * (p.x - g.x) <= 25 JOIN gi i ON i.frame_id = p.frame_id AND i.y = p.y AND i.x = p.x GROUP BY ALL), m0 AS (SELECT frame_id, y, x, n_px, sigma, " + ", ".join(f"{p}_{m} / (sigma * sigma) AS h{e}" for e, (p, m) in C.NORMAL.items()) + ", " + ", ".join(f"{p}_{m} / (sigma * sigma) AS m{e}" for e, (p, m) in C.NORMAL.items()) + " FROM q)"
for _k in range(6):
    QUALITY += f", m{_k + 1} AS (SELECT * EXCLUDE (" + ", ".join(f"m{i}{j}" for i in range(_k, 6) for j in range(i, 6)) + f"), m{_k}{_k} AS p{_k}" + "".join(f", m{i}{j} - m{_k}{i} * m{_k}{j} / m{_k}{_k} AS m{i}{j}" for i in range(_k + 1, 6) for j in range(i, 6)) + f" FROM m{_k})"
_ENTRIES = " ".join(f"h{e}" for e in C.NORMAL)
QUALITY += ", qo AS (SELECT *, ln(p0) + ln(p1) + ln(p2) + ln(p3) + ln(p4) + ln(p5) AS logdet, n_px >= 6 AND sigma >= 1e-12 AND least(p0, p1, p2, p3, p4, p5) > 0 AS valid FROM m6)"


@query("c3_subset_quality", sql(QUALITY, "frame_id y x n_px valid", f"sigma logdet {_ENTRIES}", "qo"))
def _c3(s: SparkSession, d: str) -> DataFrame:
    refs = fx.references(s, d)
    grid = G.build_grid(refs.where(F.col("y").between(4, 43) & F.col("x").between(6, 41)).select("frame_id", "y", "x"), SIDE, SIDE, 5, 3, BY)
    whole = refs.join(P.image_gradient(coeff(s, d), SIDE, SIDE).hint("merge"), ["frame_id", "y", "x"])
    return rounded(C.subset_quality(grid, whole, 5, SIDE, SIDE), "frame_id y x n_px valid", f"sigma logdet {_ENTRIES}")


START = fx.PIXEL + ", pt AS (SELECT c.frame_id, c.y, c.x, c.frame_id % 4 + c.x % 3 - 1 + (c.y % 2) / 4.0::DOUBLE AS u, c.frame_id % 4 * 2 + c.y % 5 - 2 + (c.x % 4) / 8.0::DOUBLE AS v FROM px c WHERE c.frame_id % 4 > 0 AND c.y BETWEEN 2 AND 45 AND c.x BETWEEN 2 AND 45 AND (c.y - 2) % 7 = 0 AND (c.x - 2) % 7 = 0)"
SEARCHED = START + f""", o AS (SELECT a.range - 5 AS dy, b.range - 5 AS dx FROM range(11) a, range(11) b WHERE (a.range - 5) * (a.range - 5) + (b.range - 5) * (b.range - 5) <= 25),
f0 AS (SELECT p.frame_id, p.y, p.x, p.dy, p.dx, r.val FROM (SELECT *, frame_id // 4 * 4 AS rf, {_FOLD('(pt.y + o.dy)')} AS ry, {_FOLD('(pt.x + o.dx)')} AS rx FROM pt, o) p JOIN px r ON r.frame_id = p.rf AND r.y = p.ry AND r.x = p.rx),
f1 AS (SELECT *, val - avg(val) OVER w AS c FROM f0 WINDOW w AS (PARTITION BY frame_id, y, x)), ft AS (SELECT frame_id, y, x, dy, dx, c / greatest(sqrt(sum(c * c) OVER w), 1e-12) AS f FROM f1 WINDOW w AS (PARTITION BY frame_id, y, x)),
k AS (SELECT a.range - 8 AS ky, b.range - 8 AS kx FROM range(17) a, range(17) b), ta(ay, ax) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
ge AS MATERIALIZED (SELECT p.frame_id, p.y, p.x, p.ky, p.kx, sum(r.val * (CASE WHEN ay = 0 THEN 1 - (p.v - floor(p.v)) ELSE p.v - floor(p.v) END) * (CASE WHEN ax = 0 THEN 1 - (p.u - floor(p.u)) ELSE p.u - floor(p.u) END)) AS g
  FROM (SELECT *, {_FOLD('(pt.y + floor(pt.v)::INTEGER + k.ky + ay)')} AS ry, {_FOLD('(pt.x + floor(pt.u)::INTEGER + k.kx + ax)')} AS rx FROM pt, k, ta) p JOIN px r ON r.frame_id = p.frame_id AND r.y = p.ry AND r.x = p.rx GROUP BY ALL),
sh AS (SELECT a.range - 3 AS sx, b.range - 3 AS sy FROM range(7) a, range(7) b),
sc AS (SELECT t.frame_id, t.y, t.x, t.sx, t.sy, count(*) AS n, sum(g) AS g, sum(g * g) AS gg, sum(f * g) AS fg, sum(f) AS f, sum(f * f) AS ff FROM (SELECT *, dy + sy AS ky, dx + sx AS kx FROM ft, sh) t JOIN ge e ON e.frame_id = t.frame_id AND e.y = t.y AND e.x = t.x AND e.ky = t.ky AND e.kx = t.kx GROUP BY ALL),
ds AS (SELECT *, round(1 - 2 * (fg - f * g / n) / greatest(sqrt(greatest(gg - g * g / n, 0.0)), 1e-12) + ff, 9) AS score FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, y, x ORDER BY score, sx, sy) AS k FROM ds),
fo AS (SELECT r.frame_id, r.y, r.x, p.u + sx AS u, p.v + sy AS v, score FROM rk r JOIN pt p ON p.frame_id = r.frame_id AND p.y = r.y AND p.x = r.x WHERE k = 1)"""


@query("c10_coarse_search", sql(SEARCHED, "frame_id y x", "u v score", "fo"))
def _c10(s: SparkSession, d: str) -> DataFrame:
    px = in_sets(fx.pixels(s, d))
    on = lambda c: F.col(c).between(2, 45) & ((F.col(c) - 2) % 7 == 0)
    k = F.col("frame_id") % 4
    start = px.where((k > 0) & on("y") & on("x")).select("set", "frame_id", "y", "x", (k + F.col("x") % 3 - 1 + (F.col("y") % 2) / 4.0).alias("u"), (k * 2 + F.col("y") % 5 - 2 + (F.col("x") % 4) / 8.0).alias("v"))
    found = C.coarse_search(start, px.where(k == 0).drop("frame_id"), px.where(k > 0), 5, SIDE, SIDE, ("set",), ("set", "frame_id"))
    return rounded(found, "frame_id y x", "u v score")


# Kinematics ----------------------------------------------------------------------------------
query("k1_velocity", sql(fx.VEL, "frame_idx y x", "Vx Vy", "vel"))(lambda s, d: rounded(vel(s, d), "frame_idx y x", "Vx Vy"))
query("k2_speed", f'WITH {fx.VEL} SELECT frame_idx, y, x, round(sqrt("Vx" * "Vx" + "Vy" * "Vy"), 6) AS "Veff" FROM vel')(lambda s, d: rounded(vel(s, d), "frame_idx y x", "Veff"))
SLOPES = "dVx_dx dVx_dy dVy_dx dVy_dy"
query("k3_plane_fit", sql(fx.VEL + fx.fit_sql("vel", "Vx", "Vy", "fit"), "frame_idx y x", SLOPES, "fit"))(lambda s, d: rounded(K.plane_fit(vel(s, d), ["Vx", "Vy"], RAD, SP), "frame_idx y x", SLOPES))
RATES = "Exx_rate Eyy_rate Exy_rate"
query("k4_strain_rate", sql(fx.RATE, "frame_idx y x", RATES, "rate"))(lambda s, d: rounded(K.strain_rate(vel(s, d), RAD, SP), "frame_idx y x", RATES))
query("k5_effective_rate", sql(fx.RATE, "frame_idx y x", "Eeff_rate", "rate"))(lambda s, d: rounded(K.strain_rate(vel(s, d), RAD, SP), "frame_idx y x", "Eeff_rate"))
query("k6_strain", sql(fx.STRAIN, "frame_idx y x", "Exx Eyy Exy", "strain"))(lambda s, d: rounded(strained(s, d), "frame_idx y x", "Exx Eyy Exy"))
query("k7_effective_strain", sql(fx.STRAIN, "frame_idx y x", "Eeff", "strain"))(lambda s, d: rounded(strained(s, d), "frame_idx y x", "Eeff"))
query("k8_kinematics", sql(fx.STRAIN, "frame_idx y x", "u Vx Vy Exx_rate Eeff_rate Exx Eeff", "strain"))(lambda s, d: rounded(strained(s, d), "frame_idx y x", "u Vx Vy Exx_rate Eeff_rate Exx Eeff"))
query("k9_trajectories", f"""WITH {fx.DENSE}, z AS (SELECT y, x FROM disp WHERE frame_idx = 0), ry AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r FROM (SELECT DISTINCT y FROM z)), rx AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM (SELECT DISTINCT x FROM z)),
se AS (SELECT z.y, z.x FROM z JOIN ry ON ry.y = z.y AND ry.r % 2 = 0 JOIN rx ON rx.x = z.x AND rx.r % 2 = 0), g AS (SELECT d.*, max(CASE WHEN u IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY d.y, d.x ORDER BY frame_idx) AS gone FROM dense d JOIN se ON se.y = d.y AND se.x = d.x WHERE frame_idx <= 9)
SELECT y, x, frame_idx, x + u AS px, y + v AS py FROM g WHERE gone = 0 UNION ALL SELECT y, x, -1, x, y FROM se""")(
    lambda s, d: K.trajectories(fx.disp(s, d), 9, 2).select("y", "x", F.explode("path").alias("p")).select("y", "x", "p.frame_idx", F.col("p.x").alias("px"), F.col("p.y").alias("py")))
query("k10_probe", f"WITH {fx.DISP} SELECT * FROM disp WHERE x = 12 AND y = 9")(lambda s, d: K.probe(fx.disp(s, d), 12.7, 9.2))
GL = fx.DISP + fx.fit_sql("disp", "u", "v", "fit") + ', o AS (SELECT frame_idx, y, x, 0.5 * (2 * "du_dx" + "du_dx" * "du_dx" + "dv_dx" * "dv_dx") AS "GExx", 0.5 * (2 * "dv_dy" + "du_dy" * "du_dy" + "dv_dy" * "dv_dy") AS "GEyy", 0.5 * ("du_dy" + "dv_dx" + "du_dx" * "du_dy" + "dv_dx" * "dv_dy") AS "GExy" FROM fit)'
query("k11_green_lagrange", sql(GL, "frame_idx y x", "GExx GEyy GExy", "o"))(lambda s, d: rounded(K.green_lagrange(fx.disp(s, d), RAD, SP), "frame_idx y x", "GExx GEyy GExy"))
DISC = fx.DISP + """, me AS (SELECT a.frame_idx, a.y, a.x, count(*) AS n, sum(b.x - a.x)::DOUBLE AS sx, sum(b.y - a.y)::DOUBLE AS sy, sum((b.x - a.x) * (b.x - a.x))::DOUBLE AS sxx, sum((b.y - a.y) * (b.y - a.y))::DOUBLE AS syy, sum((b.x - a.x) * (b.y - a.y))::DOUBLE AS sxy, sum(b.u) AS su, sum(b.v) AS sv,
  sum(b.u * (b.x - a.x)) AS sxu, sum(b.u * (b.y - a.y)) AS syu, sum(b.v * (b.x - a.x)) AS sxv, sum(b.v * (b.y - a.y)) AS syv
  FROM disp a JOIN disp b ON b.frame_idx = a.frame_idx AND b.y BETWEEN a.y - 15 AND a.y + 15 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= 225 GROUP BY ALL),
mc AS (SELECT *, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy FROM me), mf AS (SELECT frame_idx, y, x, """ + ", ".join(f"CASE WHEN n >= 6 AND cxx * cyy - cxy * cxy > 1e-12 THEN ((s{p}{c} - s{c} * s{p} / n) * c{q}{q} - (s{q}{c} - s{c} * s{q} / n) * cxy) / (cxx * cyy - cxy * cxy) END AS d{c}_d{p}" for c in "uv" for p, q in ("xy", "yx")) + ' FROM mc), gl AS (SELECT frame_idx, y, x, 0.5 * (2 * du_dx + du_dx * du_dx + dv_dx * dv_dx) AS "GExx", 0.5 * (2 * dv_dy + du_dy * du_dy + dv_dy * dv_dy) AS "GEyy", 0.5 * (du_dy + dv_dx + du_dx * du_dy + dv_dx * dv_dy) AS "GExy" FROM mf)'
query("k11_disc", sql(DISC, "frame_idx y x", "GExx GEyy GExy", "gl"))(lambda s, d: rounded(K.green_lagrange(fx.disp(s, d), 15, SP, "disc").where("u is not null"), "frame_idx y x", "GExx GEyy GExy"))
query("k12_finite_diff", sql(fx.VEL, "frame_idx y x", "Vx", "vel"))(lambda s, d: rounded(K.dense_frames(fx.disp(s, d), N).withColumn("Vx", K.finite_diff("u", N, FPS)), "frame_idx y x", "Vx"))
query("k13_trapz_error", f"""WITH {fx.VEL}, m AS (SELECT frame_idx, round(avg(u), 6) AS u, round(avg("Vx"), 6) AS r FROM vel GROUP BY frame_idx), p AS (SELECT *, CASE WHEN row_number() OVER t = 1 THEN 0 ELSE 0.5 * (lag(coalesce(r, 0)) OVER t + coalesce(r, 0)) / 2.0 END AS p FROM m WINDOW t AS (ORDER BY frame_idx)), a AS (SELECT *, sum(p) OVER (ORDER BY frame_idx) AS again FROM p)
SELECT frame_idx, round(again, 6) + 0.0 AS again, round(CASE WHEN u <> 0 THEN abs(again - u) / abs(u) END, 6) AS error FROM a""")(
    lambda s, d: rounded(K.trapz_error(vel(s, d).groupBy("frame_idx").agg(F.round(F.avg("u"), 6).alias("u"), F.round(F.avg("Vx"), 6).alias("r")), "r", "u", FPS), "frame_idx", "again error"))

# Statistics ----------------------------------------------------------------------------------
query("a1_field_stats", f'WITH {fx.VEL} SELECT frame_idx, round(avg("Vx"), 6) + 0.0 AS mean, round(stddev_pop("Vx"), 6) AS std, min("Vx") AS min, max("Vx") AS max, count("Vx") AS n_valid FROM vel GROUP BY frame_idx')(
    lambda s, d: A.field_stats(vel(s, d), "Vx", N).select("frame_idx", (F.round("mean", 6) + F.lit(0.0)).alias("mean"), F.round("std", 6).alias("std"), "min", "max", "n_valid"))
query("a2_global_range", f"WITH {fx.DISP} SELECT coalesce(min(u), 0.0) AS lo, coalesce(max(u), 1.0) AS hi FROM disp")(lambda s, d: A.global_range(fx.disp(s, d), "u"))
query("a3_frame_range", f"WITH {fx.DISP} SELECT frame_idx, min(u) AS lo, max(u) AS hi FROM disp GROUP BY frame_idx")(lambda s, d: A.frame_range(fx.disp(s, d), "u"))
query("a4_robust_range", f"WITH {fx.DISP} SELECT frame_idx, round(quantile_cont(u, 0.02), 6) AS lo, round(quantile_cont(u, 0.98), 6) AS hi FROM disp GROUP BY frame_idx")(lambda s, d: rounded(A.robust_range(fx.disp(s, d), "u"), "frame_idx", "lo hi"))
query("a5_symmetric_range", f'WITH {fx.VEL}, r AS (SELECT frame_idx, greatest(abs(min("Vx")), abs(max("Vx"))) AS m FROM vel GROUP BY frame_idx) SELECT frame_idx, -m AS lo, CASE WHEN m = -m THEN m + 1e-12 ELSE m END AS hi FROM r')(lambda s, d: A.scale_range(A.frame_range(vel(s, d), "Vx"), True))
query("a6_normalize", f"WITH {fx.DISP}, r AS (SELECT frame_idx, quantile_cont(u, 0.02) AS lo, quantile_cont(u, 0.98) AS hi FROM disp GROUP BY frame_idx) SELECT d.frame_idx, y, x, round(least(greatest((u - lo) / (CASE WHEN lo = hi THEN hi + 1e-12 ELSE hi END - lo), 0.0), 1.0), 6) AS u_norm FROM disp d JOIN r ON r.frame_idx = d.frame_idx")(
    lambda s, d: rounded(A.normalize(fx.disp(s, d), "u", A.scale_range(A.robust_range(fx.disp(s, d), "u"), False)), "frame_idx y x", "u_norm"))
query("a7_valid_count", f"WITH {fx.DENSE} SELECT frame_idx, count(u) AS n_valid FROM dense GROUP BY frame_idx")(lambda s, d: A.survival(fx.disp(s, d), 480, N).select("frame_idx", "n_valid"))
query("a8_agreement", f"WITH {fx.DISP} SELECT count(*) AS n, round(power(corr(u, 7 * v), 2), 6) AS r2, round(avg(u - 7 * v), 6) AS bias, round(avg(u - 7 * v) - 1.96 * stddev_samp(u - 7 * v), 6) AS low, round(avg(u - 7 * v) + 1.96 * stddev_samp(u - 7 * v), 6) AS high FROM disp")(
    lambda s, d: rounded(A.agreement(fx.disp(s, d), fx.disp(s, d).withColumn("u", 7 * F.col("v")), "u"), "n", "r2 bias low high"))
query("a9_mean_series", f"WITH {fx.DISP} SELECT frame_idx, round(avg(u), 6) AS mean FROM disp GROUP BY frame_idx")(lambda s, d: rounded(A.mean_series(fx.disp(s, d), "u"), "frame_idx", "mean"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity, strain rate and its statistics for every frame."""
    return rounded(A.field_stats(K.strain_rate(vel(spark, sf_dir), RAD, SP), "Eeff_rate", N), "frame_idx n_valid", "mean std min max")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
