"""Point and raster fixtures from the tables at hand: integer centimetres, so geometry is exact in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.model import GridSpec
from groundswell.session import importable

CELL = 25  # centimetres
UNIT = 100.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, classification: a cloud over a sloped square whose side follows the row count."""
    importable(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    side = lines.agg((3200 * F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*") / 60000.0)))).cast("long").alias("side")).first()["side"]
    made = lines.selectExpr(
        "((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey) * 1000 + l_suppkey AS point_id",
        f"(l_orderkey * 7919 + l_partkey * 10473 + l_linenumber * 129971) % {side} AS x",
        f"(l_orderkey * 6271 + l_partkey * 3571 + l_suppkey * 15485 + l_linenumber * 32452) % {side} AS y",
        "CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 5 ELSE 4 END AS classification",
        "CASE WHEN l_returnflag = 'A' THEN l_partkey % 13 ELSE CAST(l_quantity * l_quantity AS BIGINT) END + CASE WHEN l_orderkey % 997 = 0 THEN 5000 ELSE 0 END AS h",
    )
    z = F.expr("10000 + x div 8 + h")
    return made.groupBy("point_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min(z).alias("z"), F.min("classification").cast("int").alias("classification"))


POINTS_SQL = """
n AS (SELECT 3200 * CAST(greatest(1, ceil(sqrt(count(*) / 60000.0))) AS BIGINT) AS side FROM lineitem),
k AS (
  SELECT ((l_orderkey*8 + l_linenumber)*20000 + l_partkey)*1000 + l_suppkey AS pid,
         (l_orderkey*7919 + l_partkey*10473 + l_linenumber*129971) % side AS x,
         (l_orderkey*6271 + l_partkey*3571 + l_suppkey*15485 + l_linenumber*32452) % side AS y,
         CASE WHEN l_returnflag='A' THEN 2 WHEN l_returnflag='N' THEN 5 ELSE 4 END AS cls,
         CASE WHEN l_returnflag='A' THEN l_partkey % 13 ELSE CAST(l_quantity*l_quantity AS BIGINT) END
           + CASE WHEN l_orderkey % 997 = 0 THEN 5000 ELSE 0 END AS h
  FROM lineitem CROSS JOIN n),
pts AS MATERIALIZED (SELECT pid AS point_id, min(x) AS x, min(y) AS y, min(10000 + x // 8 + h) AS z, CAST(min(cls) AS INTEGER) AS classification FROM k GROUP BY pid),
g AS MATERIALIZED (SELECT min(x) AS x0, min(y) AS y0, CAST((max(x)-min(x))//25+1 AS INTEGER) AS w, CAST((max(y)-min(y))//25+1 AS INTEGER) AS h FROM pts)
"""


def grid(cloud: DataFrame) -> GridSpec:
    return GridSpec.from_points(cloud, CELL)


def nearest_sql(name: str, probes: str, build: str, k: int, dims: list[str], edge: int, payload: str = "z") -> str:
    """CTEs ending in ``name`` (point_id, rank, d2, near_id, payload): bucketed where the ring is complete, all pairs for the rest."""
    d2 = " + ".join(f"(p.{d} - q.{d})*(p.{d} - q.{d})" for d in dims)
    keys = ", ".join(f"{d}//{edge} AS k{d}" for d in dims)
    steps = ", ".join(f"(SELECT unnest([-1,0,1]) AS s{d}) t{d}" for d in dims)
    near = " AND ".join(f"q.k{d} = p.k{d} + s{d}" for d in dims)
    rank = "row_number() OVER (PARTITION BY p.point_id ORDER BY {0}, q.point_id)".format(d2)
    return f"""
{name}_q AS MATERIALIZED (SELECT *, {keys} FROM {build}),
{name}_p AS MATERIALIZED (SELECT p.*, {", ".join(f"k{d} + s{d} AS c{d}" for d in dims)} FROM (SELECT *, {keys} FROM {probes}) p, {steps}),
{name}_a AS MATERIALIZED (SELECT * FROM (SELECT p.point_id, {rank} AS rank, {d2} AS d2, q.point_id AS near_id, q.{payload} AS {payload} FROM {name}_p p JOIN {name}_q q
  ON {" AND ".join(f"q.k{d} = p.c{d}" for d in dims)} WHERE p.point_id <> q.point_id AND {d2} <= {edge * edge}) WHERE rank <= {k}),
{name}_f AS MATERIALIZED (SELECT point_id FROM {name}_a WHERE rank = {k}),
{name}_b AS MATERIALIZED (SELECT * FROM (SELECT p.point_id, {rank} AS rank, {d2} AS d2, q.point_id AS near_id, q.{payload} AS {payload}
  FROM (SELECT * FROM {probes} WHERE point_id NOT IN (SELECT point_id FROM {name}_f)) p, {build} q WHERE p.point_id <> q.point_id) WHERE rank <= {k}),
{name} AS MATERIALIZED (SELECT a.* FROM {name}_a a SEMI JOIN {name}_f f ON a.point_id = f.point_id UNION ALL SELECT * FROM {name}_b)
"""


def mean_model(bands: int, side: int, batch: int = 1) -> bytes:
    """An ONNX file of one node, the mean over the bands of (batch, bands, side, side): protocol buffer fields, written out."""

    def field(number: int, kind: int, body: bytes) -> bytes:
        return bytes([number << 3 | kind]) + (body if kind == 0 else bytes([len(body)]) + body)

    def value(name: bytes, *dims: int) -> bytes:
        shape = b"".join(field(1, 2, field(1, 0, bytes([d]))) for d in dims)
        return field(1, 2, name) + field(2, 2, field(1, 2, field(1, 0, b"\x01") + field(2, 2, shape)))

    axes = field(1, 2, b"axes") + field(8, 0, b"\x01") + b"\xa0\x01\x07"
    node = field(1, 2, b"x") + field(2, 2, b"y") + field(4, 2, b"ReduceMean") + field(5, 2, axes)
    graph = field(1, 2, node) + field(2, 2, b"g") + field(11, 2, value(b"x", batch, bands, side, side)) + field(12, 2, value(b"y", batch, 1, side, side))
    return field(1, 0, b"\x07") + field(7, 2, graph) + field(8, 2, field(2, 0, b"\x0b"))
