"""A query for each operator, over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.functions import mask_nodata, uri_strip, vegetation_density, vegetation_ratio
from groundswell.model import BANDS, GridSpec
from groundswell.operators import bands as B
from groundswell.operators import neighbours, tiling, validate
from groundswell.operators.focal import focal
from groundswell.operators.predict import predict
from groundswell.operators.rasterize import fill_gaps, idw, rasterize, rasterize_all
from groundswell.plans.surrogate import POINTS_SQL, UNIT, grid, nearest_sql, points
from groundswell.session import discard, forget, importable, tables, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Terrain is in thousandths of a centimetre as whole numbers here, so that sums and ties are the same in any engine.
MILLI = 1000
TILE, STRIDE = 32, 16


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


# Points and validation


@query(f"WITH {POINTS_SQL} SELECT point_id, x, y, z, classification FROM pts")
def scan_points(spark, sf_dir):
    return points(spark, sf_dir)


@query("SELECT page_id, regexp_replace(concat('PDAL://', url), '^pdal://', '', 'i') AS uri FROM pages")
def uri_strip_(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", uri_strip(F.concat(F.lit("PDAL://"), F.col("url"))).alias("uri"))


QUERIES["uri_strip"], SQL["uri_strip"] = QUERIES.pop("uri_strip_"), SQL.pop("uri_strip_")


@query(f"WITH {POINTS_SQL} SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n FROM pts")
def bbox(spark, sf_dir):
    return validate.bbox(points(spark, sf_dir))


AREA = "((max(x)-min(x))/100.0)::DOUBLE * ((max(y)-min(y))/100.0)::DOUBLE"


@query(f"WITH {POINTS_SQL} SELECT count(*) AS n, round({AREA}, 6) AS area, round(count(*) / ({AREA}), 6) AS density FROM pts")
def point_density(spark, sf_dir):
    return whole(validate.density(points(spark, sf_dir), unit=UNIT).select("n", "area", "density"), "area", "density")


@query(f"WITH {POINTS_SQL} SELECT CASE WHEN d < 5 THEN 'error' WHEN d > 30 THEN 'warning' ELSE 'ok' END AS density_class FROM (SELECT count(*) / ({AREA}) AS d FROM pts)")
def density_class(spark, sf_dir):
    return validate.density(points(spark, sf_dir), unit=UNIT).select(validate.density_class(F.col("density")).alias("density_class"))


@query(f"WITH {POINTS_SQL} SELECT DISTINCT classification FROM pts")
def class_codes(spark, sf_dir):
    return validate.class_codes(points(spark, sf_dir))


@query(f"WITH {POINTS_SQL} SELECT bool_or(classification = 2) AS has_ground, bool_or(classification <> 2) AS has_other FROM pts")
def class_rules(spark, sf_dir):
    return validate.class_rules(points(spark, sf_dir))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT count(*) / ({AREA}) AS d, bool_or(classification = 2) AS a, bool_or(classification <> 2) AS b,
  array_to_string(list_sort(list(DISTINCT classification)), ', ') AS codes FROM pts)
SELECT CASE WHEN d < 5 THEN 'error' WHEN d > 30 THEN 'warning' ELSE 'ok' END AS severity, 'density' AS code, format('{{:.2f}} points per square unit', d) AS message FROM r
UNION ALL SELECT 'ok', 'classes', 'classes: ' || codes FROM r
UNION ALL SELECT CASE WHEN a THEN 'ok' ELSE 'error' END, 'ground', CASE WHEN a THEN 'ground points found' ELSE 'no points of class 2' END FROM r
UNION ALL SELECT CASE WHEN b THEN 'ok' ELSE 'error' END, 'other', CASE WHEN b THEN 'other points found' ELSE 'no points but of class 2' END FROM r""")
def validation_report(spark, sf_dir):
    return validate.report(points(spark, sf_dir), unit=UNIT)


@query(f'WITH {POINTS_SQL} SELECT point_id, CAST(h - 1 - (y - y0) // 25 AS INTEGER) AS "row", CAST((x - x0) // 25 AS INTEGER) AS col FROM pts, g')
def cell_index(spark, sf_dir):
    cloud = points(spark, sf_dir)
    row, col = grid(cloud).cell_of(F.col("x"), F.col("y"))
    return cloud.select("point_id", row.alias("row"), col.alias("col"))


@query(f"""WITH {POINTS_SQL} SELECT * FROM (SELECT point_id, x, y, z, classification FROM pts WHERE classification = 2
  UNION ALL SELECT point_id, x, y, z, classification FROM pts WHERE classification <> 2)""")
def merge_clouds(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return cloud.where("classification = 2").unionByName(cloud.where("classification <> 2"))


# Neighbours

KNN = nearest_sql("nn", "pts", "pts", 8, ["x", "y", "z"], 150)
MEAN = "md AS MATERIALIZED (SELECT point_id, sum(sqrt(d2::DOUBLE)) / count(*) AS mean_dist FROM nn GROUP BY point_id)"
LIMIT = "lim AS MATERIALIZED (SELECT avg(mean_dist) AS mean, stddev_samp(mean_dist) AS stddev, avg(mean_dist) + 3.0 * stddev_samp(mean_dist) AS threshold FROM md)"
FLAG = "fl AS MATERIALIZED (SELECT p.*, coalesce(mean_dist > threshold, false) AS is_outlier, CAST(CASE WHEN mean_dist > threshold THEN 7 ELSE classification END AS INTEGER) AS cls FROM pts p LEFT JOIN md USING (point_id), lim)"
FLAGS = f"{KNN}, {MEAN}, {LIMIT}, {FLAG}"


@query(f"WITH {POINTS_SQL}, {KNN} SELECT point_id, CAST(rank AS INTEGER) AS rank, d2, near_id FROM nn")
def knn_topk(spark, sf_dir):
    cloud = points(spark, sf_dir)
    return neighbours.nearest(cloud, cloud, 8, ["x", "y", "z"]).select("point_id", F.col("rank").cast("int").alias("rank"), "d2", "near_id")


@query(f"WITH {POINTS_SQL}, {KNN}, {MEAN} SELECT point_id, round(mean_dist, 6) AS mean_dist FROM md")
def knn_mean_distance(spark, sf_dir):
    return whole(neighbours.mean_distances(points(spark, sf_dir)), "mean_dist")


@query(f"WITH {POINTS_SQL}, {KNN}, {MEAN}, {LIMIT} SELECT round(mean, 6) AS mean, round(stddev, 6) AS stddev, round(threshold, 6) AS threshold FROM lim")
def outlier_stats(spark, sf_dir):
    return whole(neighbours.outlier_stats(neighbours.mean_distances(points(spark, sf_dir))), "mean", "stddev", "threshold")


@query(f"WITH {POINTS_SQL}, {FLAGS} SELECT point_id, is_outlier, cls AS classification FROM fl")
def outlier_flag(spark, sf_dir):
    return neighbours.flag_outliers(points(spark, sf_dir), columns=["point_id", "classification"]).select("point_id", "is_outlier", "classification")


HAG = f"""grd AS MATERIALIZED (SELECT * FROM pts WHERE classification = 2), veg AS MATERIALIZED (SELECT * FROM pts WHERE classification <> 2),
{nearest_sql("hn", "veg", "grd", 1, ["x", "y"], 100)},
hg AS MATERIALIZED (SELECT p.*, CASE WHEN classification = 2 THEN 0 ELSE p.z - hn.z END AS hag FROM pts p LEFT JOIN hn USING (point_id))"""


def heights(spark, sf_dir) -> DataFrame:
    return neighbours.height_above_ground(points(spark, sf_dir))


@query(f"WITH {POINTS_SQL}, {HAG} SELECT point_id, hag FROM hg")
def hag_nn(spark, sf_dir):
    return heights(spark, sf_dir).select("point_id", "hag")


@query(f"WITH {POINTS_SQL}, {FLAGS} SELECT point_id FROM fl WHERE cls = 2")
def filter_ground(spark, sf_dir):
    return neighbours.flag_outliers(points(spark, sf_dir), columns=["point_id", "classification"]).where("classification = 2").select("point_id")


@query(f"WITH {POINTS_SQL}, {HAG} SELECT point_id, hag FROM hg WHERE hag < 80")
def filter_low_veg(spark, sf_dir):
    return heights(spark, sf_dir).where("hag < 80").select("point_id", "hag")


@query(f"WITH {POINTS_SQL}, {HAG} SELECT point_id, hag FROM hg WHERE hag <= 1200")
def filter_high_veg(spark, sf_dir):
    return heights(spark, sf_dir).where("hag <= 1200").select("point_id", "hag")


# Rasters


def hits_sql(name: str, source: str) -> str:
    """Points of ``source`` with the cells (north-up) whose centres are strictly within 25 * sqrt(2)."""
    return f"""{name} AS MATERIALIZED (SELECT s.*, CAST(h - 1 - r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, q FROM (
  SELECT p.*, g.h, (x - x0)//25 + i AS c, (y - y0)//25 + j AS r, g.w,
    (2*(x-x0) - (2*((x - x0)//25 + i)+1)*25)*(2*(x-x0) - (2*((x - x0)//25 + i)+1)*25) + (2*(y-y0) - (2*((y - y0)//25 + j)+1)*25)*(2*(y-y0) - (2*((y - y0)//25 + j)+1)*25) AS q
  FROM {source} p, g, (SELECT unnest([-2,-1,0,1,2]) AS i) a, (SELECT unnest([-2,-1,0,1,2]) AS j) b) s
  WHERE q < 5000 AND c BETWEEN 0 AND w - 1 AND r BETWEEN 0 AND h - 1)"""


IDW = """coalesce(arg_min(z::DOUBLE, point_id) FILTER (q = 0), sum(z * (1 / pow(q::DOUBLE, 3))) FILTER (q <> 0) / sum(1 / pow(q::DOUBLE, 3)) FILTER (q <> 0))"""
DTM = f"""{FLAGS}, gr AS MATERIALIZED (SELECT * FROM fl WHERE cls = 2), {hits_sql("gh", "gr")},
dtm AS MATERIALIZED (SELECT "row", col, round({IDW} * 1000) AS value FROM gh GROUP BY "row", col)"""


def fill_sql(name: str, source: str, window: int, weight: int) -> str:
    return f"""{name}_all AS MATERIALIZED (SELECT CAST(r.i AS INTEGER) AS "row", CAST(c.i AS INTEGER) AS col FROM g, range(g.h) r(i), range(g.w) c(i)),
{name}_gap AS MATERIALIZED (SELECT a.* FROM {name}_all a ANTI JOIN {source} s ON a."row" = s."row" AND a.col = s.col),
{name} AS MATERIALIZED (SELECT "row", col, value FROM {source} UNION ALL
  SELECT e."row", e.col, sum(s.value * ({weight} // greatest(abs(i), abs(j)))) / sum({weight} // greatest(abs(i), abs(j))) AS value
  FROM {name}_gap e, range(-{window}, {window} + 1) a(i), range(-{window}, {window} + 1) b(j), {source} s
  WHERE (i <> 0 OR j <> 0) AND s."row" = e."row" + i AND s.col = e.col + j GROUP BY e."row", e.col)"""


def alone(make: Query, spark, sf_dir, label: str) -> tuple[DataFrame, GridSpec]:
    """Cells and their grid, the cells written and settled; tables that were written on the way are removed."""
    before = tables()
    cells, spec = make(spark, sf_dir)
    table = neighbours.settled(written(cells, label))
    forget(spark, before | {table.written_to})
    return table, spec


def terrain(spark, sf_dir) -> tuple[DataFrame, GridSpec]:
    cloud = written(points(spark, sf_dir), "points", "zstd")
    spec = grid(cloud)
    ground = neighbours.flag_outliers(cloud).where("classification = 2").select("point_id", "x", "y", "z")
    discard(cloud)  # its columns went along
    cells = rasterize_all(ground, spec, {"value": F.round(idw(F.col("z")) * MILLI)})
    return cells, spec


@query(f'WITH {POINTS_SQL}, {DTM} SELECT "row", col, value FROM dtm')
def dtm_idw(spark, sf_dir):
    return terrain(spark, sf_dir)[0]


@query(f"""WITH {POINTS_SQL}, {hits_sql("d", "pts")}, x AS (SELECT "row", col, count(*)::DOUBLE AS disc FROM d GROUP BY ALL),
y AS (SELECT CAST(h - 1 - (y - y0)//25 AS INTEGER) AS "row", CAST((x - x0)//25 AS INTEGER) AS col, count(*)::DOUBLE AS bin FROM pts, g GROUP BY ALL)
SELECT "row", col, disc, bin FROM x FULL JOIN y USING ("row", col)""")
def raster_bin_vs_disc(spark, sf_dir):
    cloud = points(spark, sf_dir)
    spec = grid(cloud)
    disc, bin_ = (rasterize(cloud, spec, how="count", binning=b).withColumnRenamed("value", b) for b in ("disc", "bin"))
    return disc.join(bin_, ["row", "col"], "full")


VEG = f"""{HAG}, {hits_sql("hh", "hg")},
vg AS MATERIALIZED (SELECT "row", col, max(hag)::DOUBLE AS chm, count(*) FILTER (hag < 80)::DOUBLE AS low, count(*) FILTER (hag <= 1200)::DOUBLE AS high FROM hh GROUP BY "row", col)"""


def canopy(spark, sf_dir) -> tuple[DataFrame, GridSpec]:
    """chm, low and high of each cell from one pass over the points' hits."""
    cloud = written(points(spark, sf_dir), "points", "zstd")
    spec = grid(cloud)
    tall = neighbours.height_above_ground(cloud)
    values = {"chm": F.max("hag").cast("double"), "low": F.count_if(F.col("hag") < 80).cast("double"), "high": F.count_if(F.col("hag") <= 1200).cast("double")}
    return rasterize_all(tall, spec, values), spec


@query(f'WITH {POINTS_SQL}, {VEG} SELECT "row", col, chm AS value FROM vg')
def chm_max(spark, sf_dir):
    return canopy(spark, sf_dir)[0].select("row", "col", F.col("chm").alias("value"))


@query(f'WITH {POINTS_SQL}, {VEG} SELECT "row", col, low AS value FROM vg WHERE low > 0')
def low_veg_count(spark, sf_dir):
    return canopy(spark, sf_dir)[0].where("low > 0").select("row", "col", F.col("low").alias("value"))


@query(f'WITH {POINTS_SQL}, {VEG} SELECT "row", col, high AS value FROM vg WHERE high > 0')
def high_veg_count(spark, sf_dir):
    return canopy(spark, sf_dir)[0].where("high > 0").select("row", "col", F.col("high").alias("value"))


SPARSE = """sp AS MATERIALIZED (SELECT CAST(h - 1 - (y - y0)//25 AS INTEGER) AS "row", CAST((x - x0)//25 AS INTEGER) AS col, max(z)::DOUBLE AS value FROM pts, g WHERE classification = 2 GROUP BY ALL)"""


@query(f'WITH {POINTS_SQL}, {SPARSE}, {fill_sql("f", "sp", 12, 27720)} SELECT "row", col, round(value, 6) AS value FROM f')
def window_fill(spark, sf_dir):
    cloud = written(points(spark, sf_dir), "points", "zstd")
    spec = grid(cloud)
    return whole(fill_gaps(rasterize(cloud.where("classification = 2"), spec, how="max", binning="bin"), spec, 12), "value")


FILLED = f"{DTM}, {fill_sql('df', 'dtm', 12, 27720)}"
FOCAL = """fo AS MATERIALIZED (SELECT a."row", a.col, any_value(a.value) AS value, list_sort(list(coalesce(b.value, 0.0)))[51] AS med FROM (
  SELECT c."row", c.col, d.value, CASE WHEN c."row"+i < 0 THEN -(c."row"+i)-1 WHEN c."row"+i >= g.h THEN 2*g.h-1-(c."row"+i) ELSE c."row"+i END AS sr,
    CASE WHEN c.col+j < 0 THEN -(c.col+j)-1 WHEN c.col+j >= g.w THEN 2*g.w-1-(c.col+j) ELSE c.col+j END AS sc
  FROM df_all c LEFT JOIN df d ON c."row" = d."row" AND c.col = d.col, g, range(-5, 5) x(i), range(-5, 5) y(j)) a
  LEFT JOIN df b ON b."row" = a.sr AND b.col = a.sc GROUP BY a."row", a.col)"""


def smooth_terrain(spark, sf_dir) -> tuple[DataFrame, DataFrame, GridSpec]:
    cells, spec = alone(terrain, spark, sf_dir, "terrain")
    full = neighbours.settled(written(fill_gaps(cells, spec, 12), "dtm"))
    discard(cells)
    return full, focal(full, spec), spec


@query(f'WITH {POINTS_SQL}, {FILLED}, {FOCAL} SELECT "row", col, round(med, 6) AS value FROM fo')
def focal_median(spark, sf_dir):
    return whole(smooth_terrain(spark, sf_dir)[1], "value")


LIM = 100 * MILLI


@query(f'WITH {POINTS_SQL}, {FILLED}, {FOCAL} SELECT "row", col, round(greatest(-{LIM}.0, least({LIM}.0, coalesce(value, 0.0) - med)), 6)::DOUBLE AS value FROM fo')
def mrm(spark, sf_dir):
    full, smooth, _ = smooth_terrain(spark, sf_dir)
    return whole(B.relief(full, smooth, float(LIM)), "value")


@query(f'WITH {POINTS_SQL}, {VEG} SELECT "row", col, round(CASE WHEN high <> 0 THEN low / high ELSE 0.0 END, 6)::DOUBLE AS value FROM vg')
def vdi_ratio(spark, sf_dir):
    return whole(canopy(spark, sf_dir)[0].select("row", "col", vegetation_ratio(F.col("low"), F.col("high")).alias("value")), "value")


VDI = "CASE WHEN high = 0 OR low / high = 0 THEN 0.1 WHEN low / high > 1 THEN 1.0 ELSE low / high END::DOUBLE"


@query(f'WITH {POINTS_SQL}, {VEG} SELECT "row", col, round({VDI}, 6) AS value FROM vg')
def vdi(spark, sf_dir):
    return whole(canopy(spark, sf_dir)[0].select("row", "col", vegetation_density(F.col("low"), F.col("high")).alias("value")), "value")


@query(f"""WITH {POINTS_SQL}, gg AS (SELECT min(x) AS x0, min(y) AS y0, (max(y)-min(y))//25+1 AS h FROM pts WHERE classification = 2),
a AS (SELECT CAST(h - 1 - (y - y0)//25 AS INTEGER) AS "row", CAST((x - x0)//25 AS INTEGER) AS col, max(z)::DOUBLE AS a FROM pts, gg WHERE classification = 2 GROUP BY ALL),
b AS (SELECT CAST(h - 1 - (y - y0)//25 AS INTEGER) AS "row", CAST((x - x0)//25 AS INTEGER) AS col, count(*)::DOUBLE AS b FROM pts, g GROUP BY ALL),
m AS (SELECT least((SELECT max("row") FROM a), (SELECT max("row") FROM b)) AS r, least((SELECT max(col) FROM a), (SELECT max(col) FROM b)) AS c)
SELECT "row", col, a, b FROM a JOIN b USING ("row", col), m WHERE "row" <= r AND col <= c""")
def align_crop(spark, sf_dir):
    """Each raster on the extent of its own points, aligned by index."""
    cloud = points(spark, sf_dir)
    ground = cloud.where("classification = 2")
    return B.crop(rasterize(ground, grid(ground), how="max", binning="bin"), rasterize(cloud, grid(cloud), how="count", binning="bin"))


@query('SELECT event_id, nullif(round(value), 10.0) AS value FROM events')
def nodata_mask(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", mask_nodata(F.round("value"), 10.0).alias("value"))


STACK = f"""{FILLED}, {FOCAL}, {VEG}, cv AS MATERIALIZED (SELECT "row", col, chm AS value FROM vg), {fill_sql("cf", "cv", 3, 6)},
st AS MATERIALIZED (SELECT c."row", c.col, df.value AS dtm, cf.value AS chm, greatest(-{LIM}.0, least({LIM}.0, coalesce(fo.value, 0.0) - med))::DOUBLE AS mrm, coalesce({VDI}, 0.1) AS vdi
FROM df_all c LEFT JOIN df USING ("row", col) LEFT JOIN cf USING ("row", col) LEFT JOIN fo USING ("row", col) LEFT JOIN vg USING ("row", col))"""


def stacked(spark, sf_dir) -> tuple[DataFrame, GridSpec]:
    """The four bands on the shared grid, as the one table that is left of their making."""
    return alone(bands_of, spark, sf_dir, "stack")


def bands_of(spark, sf_dir) -> tuple[DataFrame, GridSpec]:
    full, smooth, spec = smooth_terrain(spark, sf_dir)
    veg, _ = alone(canopy, spark, sf_dir, "canopy")
    relief = B.relief(full, smooth, float(LIM))
    chm = fill_gaps(veg.select("row", "col", F.col("chm").alias("value")), spec, 3)
    known = veg.select("row", "col", vegetation_density(F.col("low"), F.col("high")).alias("value"))
    none = spec.all_cells(spark).join(known, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.1)).alias("value"))
    return B.stack({"dtm": full, "chm": chm, "mrm": relief, "vdi": none}), spec


STACK_OUT = ", ".join(f"round({b}, 6) AS {b}" for b in BANDS)


@query(f'WITH {POINTS_SQL}, {STACK} SELECT "row", col, {STACK_OUT} FROM st')
def band_stack(spark, sf_dir):
    return whole(stacked(spark, sf_dir)[0], *BANDS)


QUANTILES = ", ".join(f"quantile_cont({b}, 0.01) AS {b}_1, quantile_cont({b}, 0.99) AS {b}_99" for b in BANDS)


@query(f"WITH {POINTS_SQL}, {STACK} SELECT " + ", ".join(f"round(quantile_cont({b}, {p}), 6) AS {b}_{n}" for b in BANDS for p, n in ((0.01, 1), (0.99, 99))) + " FROM st")
def band_percentiles(spark, sf_dir):
    found = B.percentiles(stacked(spark, sf_dir)[0], BANDS, [0.01, 0.99])
    row = {f"{b}_{n}": v for b in BANDS for n, v in zip((1, 99), found[b])}
    return spark.range(1).select(*[F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in row.items()])


NORMAL = f"""{STACK}, qs AS MATERIALIZED (SELECT {QUANTILES} FROM st),
nm AS MATERIALIZED (SELECT "row", col, {", ".join(f"CASE WHEN {b} IS NOT NULL THEN greatest(0.0, least(1.0, ({b} - {b}_1) / ({b}_99 - {b}_1 + 1e-10)))::DOUBLE END AS {b}" for b in BANDS)} FROM st, qs)"""


def normal(spark, sf_dir) -> tuple[DataFrame, GridSpec]:
    wide, spec = stacked(spark, sf_dir)
    return B.normalize(wide), spec


@query(f'WITH {POINTS_SQL}, {NORMAL} SELECT "row", col, {STACK_OUT} FROM nm')
def normalize(spark, sf_dir):
    return whole(normal(spark, sf_dir)[0], *BANDS)


# Tiles: grids from the number of suppliers, values from their keys


def scene(spark, sf_dir) -> tuple[DataFrame, int, int]:
    """An event count raster of 70 x 50 cells: value by position from the events table."""
    importable(spark)
    cells = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") % 70).cast("int").alias("row"), (F.col("user_id") % 50).cast("int").alias("col"))
    return cells.groupBy("row", "col").agg(F.count("*").cast("double").alias("value")), 70, 50


SCENE = 'sc AS MATERIALIZED (SELECT CAST(event_id % 70 AS INTEGER) AS "row", CAST(user_id % 50 AS INTEGER) AS col, count(*)::DOUBLE AS value FROM events GROUP BY ALL)'
WEIGHTS = """wr AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, sqrt((i+0.5::DOUBLE-{h})*(i+0.5::DOUBLE-{h}) + (j+0.5::DOUBLE-{h})*(j+0.5::DOUBLE-{h})) AS dc,
  least(sqrt(least((i+0.5::DOUBLE)*(i+0.5::DOUBLE), (i+0.5::DOUBLE-{n})*(i+0.5::DOUBLE-{n})) + 0.25), sqrt(least((j+0.5::DOUBLE)*(j+0.5::DOUBLE), (j+0.5::DOUBLE-{n})*(j+0.5::DOUBLE-{n})) + 0.25)) AS de
  FROM range({n}) a(i), range({n}) b(j)),
wt AS MATERIALIZED (SELECT i, j, de/(dc+de) * ({n}*{n} / sum(de/(dc+de)) OVER ()) AS w FROM wr)"""


@query(f"WITH {WEIGHTS.format(n=224, h=112)} SELECT i, j, round(w, 6) AS w FROM wt")
def pyramid_weights(spark, sf_dir):
    return whole(tiling.pyramid_weights(spark, 224), "w")


@query("""WITH s AS (SELECT count(DISTINCT l_partkey) AS h, count(DISTINCT l_suppkey) AS w FROM lineitem)
SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CAST(ty * 112 AS INTEGER) AS y0, CAST(tx * 112 AS INTEGER) AS x0 FROM s,
  range(greatest(1, CAST(ceil(h / 112.0) AS BIGINT) - 1)) a(ty), range(greatest(1, CAST(ceil(w / 112.0) AS BIGINT) - 1)) b(tx)""")
def tile_grid(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.countDistinct("l_partkey"), F.countDistinct("l_suppkey")).first()
    return tiling.tile_grid(spark, r[0], r[1])


# 70 x 50 cells in tiles of 32 by 16: 4 x 3 tiles; the padded scene is 80 x 64.
ASSIGN = f"""ta AS MATERIALIZED (SELECT "row", col, value, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CAST("row" - ty*{STRIDE} AS INTEGER) AS i, CAST(col - tx*{STRIDE} AS INTEGER) AS j
FROM {{0}}, range(4) a(ty), range(3) b(tx) WHERE "row" - ty*{STRIDE} BETWEEN 0 AND {TILE - 1} AND col - tx*{STRIDE} BETWEEN 0 AND {TILE - 1})"""
PAD = """pd AS MATERIALIZED (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, value FROM range(80) a(r), range(64) b(c), sc
WHERE sc."row" = CASE WHEN r >= 70 THEN 2*69 - r ELSE r END AND sc.col = CASE WHEN c >= 50 THEN 2*49 - c ELSE c END)"""


@query(f'WITH {SCENE}, {ASSIGN.format("sc")} SELECT "row", col, ty, tx, i, j FROM ta')
def tile_assign(spark, sf_dir):
    cells, h, w = scene(spark, sf_dir)
    return tiling.tile_assign(cells, h, w, TILE, STRIDE).select("row", "col", "ty", "tx", "i", "j")


@query(f'WITH {SCENE}, {PAD} SELECT "row", col, value FROM pd')
def reflect_pad(spark, sf_dir):
    cells, h, w = scene(spark, sf_dir)
    return tiling.reflect_pad(cells, h, w, TILE, STRIDE).select("row", "col", "value")


@query(f"""WITH {SCENE} SELECT 0 AS aug, "row", col, value FROM sc UNION ALL SELECT 1, CAST(49 - col AS INTEGER), "row", value FROM sc UNION ALL SELECT 2, CAST(69 - "row" AS INTEGER), col, value FROM sc""")
def augment_coords(spark, sf_dir):
    cells, h, w = scene(spark, sf_dir)
    out = None
    for k, op in enumerate(tiling.AUGMENTATIONS):
        one = tiling.augment(cells, op, h, w).select(F.lit(k).alias("aug"), "row", "col", "value")
        out = one if out is None else out.unionByName(one)
    return out


@query(f'WITH {SCENE}, {ASSIGN.format("sc")} SELECT ty, tx, i, j, value FROM ta WHERE i BETWEEN 4 AND 27 AND j BETWEEN 4 AND 27')
def drop_border(spark, sf_dir):
    cells, h, w = scene(spark, sf_dir)
    return tiling.drop_borders(tiling.tile_assign(cells, h, w, TILE, STRIDE), TILE, 4).select("ty", "tx", "i", "j", "value")


@query(f'WITH {SCENE}, v AS (SELECT * FROM sc WHERE value > (SELECT avg(value) * 1.5 FROM sc)) SELECT CAST(min("row") AS INTEGER) AS r0, CAST(max("row") + 1 AS INTEGER) AS r1, CAST(min(col) AS INTEGER) AS c0, CAST(max(col) + 1 AS INTEGER) AS c1 FROM v')
def nodata_window(spark, sf_dir):
    cells, _, _ = scene(spark, sf_dir)
    mean = cells.agg(F.avg("value")).first()[0]
    marked = cells.withColumn("value", F.when(F.col("value") > mean * 1.5, F.col("value")).otherwise(-1.0))
    r = tiling.data_window(marked, "value", -1.0) or (None,) * 4
    return spark.range(1).select(*[F.lit(v).cast("int").alias(n) for n, v in zip(("r0", "r1", "c0", "c1"), r)])


MEANS = f'{SCENE}, {PAD}, {ASSIGN.format("pd")}, tm AS MATERIALIZED (SELECT ty, tx, sum(value) / {TILE * TILE} AS p FROM ta GROUP BY ty, tx)'
BLEND = f"""{WEIGHTS.format(n=TILE, h=TILE // 2)}, bl AS MATERIALIZED (SELECT CAST(ty*{STRIDE} + i AS INTEGER) AS "row", CAST(tx*{STRIDE} + j AS INTEGER) AS col, sum(p*w) / (sum(w) + 1e-7) AS value FROM tm, wt GROUP BY ALL)"""


@query(f'WITH {MEANS}, {BLEND} SELECT "row", col, round(value, 6) AS value FROM bl WHERE "row" < 70 AND col < 50')
def tile_blend(spark, sf_dir):
    """The mean of each tile as its prediction, blended."""
    cells, h, w = scene(spark, sf_dir)
    inside = tiling.tile_assign(tiling.reflect_pad(cells, h, w, TILE, STRIDE), h, w, TILE, STRIDE)
    means = inside.groupBy("ty", "tx").agg((F.sum("value") / (TILE * TILE)).alias("value"))
    weights = tiling.pyramid_weights(spark, TILE)
    spots = means.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1))))
    return whole(tiling.blend(spots, weights, STRIDE).where(f"row < {h} AND col < {w}"), "value")


@query(f"""WITH {SCENE} SELECT "row", col, round(avg(value), 6) AS value FROM (SELECT "row", col, value FROM sc
  UNION ALL SELECT "row", col, value * 2 FROM sc UNION ALL SELECT "row", col, value * 6 FROM sc) GROUP BY "row", col""")
def augment_mean(spark, sf_dir):
    """Three variants, each there and back, with different values, averaged."""
    cells, h, w = scene(spark, sf_dir)
    out = None
    for op, times in zip(tiling.AUGMENTATIONS, (1, 2, 6)):
        one = tiling.deaugment(tiling.augment(cells, op, h, w), op, h, w).select("row", "col", (F.col("value") * times).alias("value"))
        out = one if out is None else out.unionByName(one)
    return whole(out.groupBy("row", "col").agg(F.avg("value").alias("value")), "value")


def channel_mean(batch: np.ndarray) -> np.ndarray:
    return batch.mean(axis=1, keepdims=True)


def channel_levels(batch: np.ndarray) -> np.ndarray:
    return np.floor(8 * batch.mean(axis=1, keepdims=True, dtype=np.float64) + 0.37) / 8


@query("""SELECT vec_id, round((embedding[1]::DOUBLE + embedding[17] + embedding[33] + embedding[49]) / 4, 5) AS first, round((embedding[16]::DOUBLE + embedding[32] + embedding[48] + embedding[64]) / 4, 5) AS last FROM embeddings""")
def predict_pointwise(spark, sf_dir):
    """Vectors of 64 as tiles of 4 bands of 4 x 4; the model is the mean of the bands."""
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("data"))
    out = predict(tiles, channel_mean, 4, 4, batch_size=256)
    return out.select("vec_id", F.round(F.element_at("data", 1).cast("double"), 5).alias("first"), F.round(F.element_at("data", 16).cast("double"), 5).alias("last"))


@query(f"""WITH {POINTS_SQL}, {NORMAL} SELECT "row", col, floor(8 * (coalesce(dtm,0)+coalesce(chm,0)+coalesce(mrm,0)+coalesce(vdi,0))/4 + 0.37) / 8 AS p FROM nm""")
def infer_end_to_end(spark, sf_dir):
    """Preprocessing, then overlapped, augmented, blended segmentation with the mean of the bands in eighths as the model.

    A model of single cells must come out of the blending as it is."""
    wide, spec = normal(spark, sf_dir)
    scene_, _ = tiling.segment(wide, spec, channel_levels, BANDS, TILE, STRIDE)
    return scene_.select("row", "col", F.round(F.col("p").cast("double"), 4).alias("p"))


@query(f'WITH {SCENE} SELECT "row", col, value FROM sc')
def scan_raster(spark, sf_dir):
    """A raster written and read again."""
    from groundswell.session import shared_folder
    from groundswell.sources.raster import read_raster, write_raster

    import uuid

    cells, h, w = scene(spark, sf_dir)
    path = f"{shared_folder(spark)}/raster-{uuid.uuid4().hex}"
    write_raster(cells, GridSpec(0.0, 0.0, 1.0, w, h), path, band_names=["value"])
    return read_raster(spark, path)[0]


def _file(spark: SparkSession, ending: str) -> str:
    import uuid

    from groundswell.session import shared_folder

    return f"{shared_folder(spark)}/file-{uuid.uuid4().hex}{ending}"


LEVEL = "floor(8 * {} + 0.37) / 8"  # eighths go through float32 as they are


def _levels(*columns: str) -> list:
    return [(F.floor(8 * F.col(c) + 0.37) / 8).alias(c) for c in columns]


TIFF_BANDS = ", ".join(f"nullif({LEVEL.format(f'coalesce({b}, 0.0)')}, 0.0) AS {b}" for b in BANDS)


@query(f'WITH {POINTS_SQL}, {NORMAL}, t AS (SELECT "row", col, {TIFF_BANDS} FROM nm) SELECT * FROM t WHERE coalesce({", ".join(BANDS)}) IS NOT NULL')
def normalized_geotiff(spark, sf_dir):
    """The four bands as one GeoTIFF, read again: all bands, zeros as missing."""
    from groundswell.sources.raster import read_raster, write_raster

    wide, spec = normal(spark, sf_dir)
    path = _file(spark, ".tif")
    write_raster(wide.fillna(0.0, BANDS).select("row", "col", *_levels(*BANDS)), spec, path, "geotiff", BANDS)
    return read_raster(spark, path, "geotiff")[0]


@query(f'WITH {SCENE} SELECT "row", col, value FROM sc')
def band_mosaic(spark, sf_dir):
    """One band as a mosaic of files of 32 x 32 cells, read again."""
    from groundswell.sources.raster import read_raster, write_raster

    cells, h, w = scene(spark, sf_dir)
    path = _file(spark, "")
    write_raster(cells, GridSpec(0.0, 0.0, 1.0, w, h), path, "mosaic", ["value"], block=32)
    return read_raster(spark, path, "mosaic")[0]


@query(f"""WITH {POINTS_SQL}, {NORMAL} SELECT "row", col, nullif(floor(8 * (coalesce(dtm,0)+coalesce(chm,0)+coalesce(mrm,0)+coalesce(vdi,0))/4 + 0.37) / 8, 0.0) AS p FROM nm WHERE floor(8 * (coalesce(dtm,0)+coalesce(chm,0)+coalesce(mrm,0)+coalesce(vdi,0))/4 + 0.37) / 8 <> 0""")
def trail_map_geotiff(spark, sf_dir):
    """The end of the second pipeline: a probability map written as a GeoTIFF and read again, by batches of tiles of 224 by 112."""
    from groundswell.model import ModelConfig
    from groundswell.plans.pipelines import infer
    from groundswell.sources.raster import read_raster, write_raster

    wide, spec = normal(spark, sf_dir)
    found, _ = infer(wide, spec, channel_levels, ModelConfig(tile=min(224, spec.height, spec.width) // 2 * 2, stride=min(224, spec.height, spec.width) // 2, batch_size=4))
    path = _file(spark, ".tif")
    write_raster(found.withColumn("p", F.round("p", 4)), spec, path, "geotiff", ["p"])
    return read_raster(spark, path, "geotiff")[0]


@query("""SELECT vec_id, floor(8 * (embedding[1]::DOUBLE + embedding[17] + embedding[33] + embedding[49]) / 4 + 0.37) / 8 AS first, floor(8 * (embedding[16]::DOUBLE + embedding[32] + embedding[48] + embedding[64]) / 4 + 0.37) / 8 AS last FROM embeddings""")
def predict_onnx(spark, sf_dir):
    """A model file, loaded from the shared folder, on batches; its raw output in eighths."""
    from groundswell.operators.predict import load_model
    from groundswell.plans.surrogate import mean_model
    from groundswell.sources import files

    path = _file(spark, ".onnx")
    files.write(path, [mean_model(4, 4)])
    tiles = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("data"))
    out = predict(tiles, load_model(path), 4, 4)
    return out.select("vec_id", F.element_at("data", 1).cast("double").alias("first"), F.element_at("data", 16).cast("double").alias("last")).select("vec_id", *_levels("first", "last"))


@query(f"""WITH {SCENE}, m AS (SELECT r, c, CASE WHEN r BETWEEN 12 AND 55 AND c BETWEEN 8 AND 41 THEN (coalesce(value, 0.0) + 1) / 64 ELSE 0.0 END AS value FROM range(70) a(r), range(50) b(c) LEFT JOIN sc ON sc."row" = r AND sc.col = c)
SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, {LEVEL.format("value")} AS p FROM m""")
def zero_pad(spark, sf_dir):
    """Segmentation of the window that has data, with zeros around it up to the whole grid."""
    cells, h, w = scene(spark, sf_dir)
    inside = F.col("row").between(12, 55) & F.col("col").between(8, 41)
    spec = GridSpec(0.0, 0.0, 1.0, w, h)
    full = spec.all_cells(spark).join(cells, ["row", "col"], "left")
    wide = written(full.withColumn("value", F.when(inside, (F.coalesce("value", F.lit(0.0)) + 1) / 64).otherwise(0.0)), "windowed")
    out, _ = tiling.segment(wide, spec, channel_levels, ["value"], TILE, STRIDE, nodata=0.0, batch_size=4)
    return out.select("row", "col", F.round(F.col("p").cast("double"), 4).alias("p"))


@query(f"WITH {POINTS_SQL}, {FLAGS} SELECT point_id, x, y, z, cls AS classification FROM fl WHERE cls = 2")
def stage_list(spark, sf_dir):
    """A stage list from a reader to the ground filter, run on a file in the shared folder."""
    from groundswell.plans import stages

    path = _file(spark, "")
    points(spark, sf_dir).write.parquet(path)
    chain = [{"type": "readers.parquet"}, {"type": "filters.outlier", "mean_k": 8, "multiplier": 3.0}, {"type": "filters.expression", "expression": "Classification == 2"}]
    found, _ = stages.run(None, chain, spark=spark, options={"readers.parquet": {"filename": path}})
    return found.select("point_id", *[F.col(c).cast("long").alias(c) for c in "xyz"], "classification")


@query("""SELECT * FROM (VALUES ('default', 'b', 'warning', 'crs'), ('none', NULL, 'error', 'crs'), ('source', 'a', NULL, NULL)) v("case", crs, severity, code)""")
def crs_findings(spark, sf_dir):
    """Which CRS a cloud has and what is said about it: from its source, from the default, from neither."""
    rows = []
    for case, source, default in (("source", "a", "b"), ("default", None, "b"), ("none", None, None)):
        known, findings = validate.crs_of(source, default)
        rows.append((case, known, *(findings[0][:2] if findings else (None, None))))
    return spark.createDataFrame(rows, "case string, crs string, severity string, code string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



