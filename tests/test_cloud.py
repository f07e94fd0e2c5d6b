"""Validation, neighbours and outliers against brute force, and their edges."""

import math
import random

import numpy as np
import pytest

from groundswell.model import GridSpec
from groundswell.operators import neighbours, validate

COLS = "point_id long, x double, y double, z double, classification int"


def cloud(spark, rows):
    return spark.createDataFrame(rows, COLS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    made = [(k, r.random() * 20, r.random() * 20, r.random() * 3, r.choice([2, 2, 4, 5])) for k in range(400)]
    made += [(500 + k, 3.0, 3.0, 0.5 * k, 2) for k in range(4)]  # one place
    made += [(600, 10.0, 10.0, 90.0, 5), (601, 300.0, 10.0, 1.0, 5)]  # far off
    return made


@pytest.mark.parametrize("n, area, kind", [(499, 100.0, "error"), (500, 100.0, "ok"), (3000, 100.0, "ok"), (3001, 100.0, "warning")])
def test_density_limits(spark, n, area, kind):
    side = math.sqrt(area)
    rows = [(k, side * (k == 1), side * (k == 1), 0.0, 2 + 3 * (k % 2)) for k in range(n)]
    assert validate.report(cloud(spark, rows)).where("code = 'density'").first()["severity"] == kind


def test_no_area_takes_the_warning_branch(spark):
    rows = [(k, 1.0, float(k), 0.0, 2 + k) for k in range(3)]
    assert validate.density(cloud(spark, rows)).first()["density"] == float("inf")
    assert [f[:2] for f in validate.validate(cloud(spark, rows), "crs")] == [("warning", "density")]


def test_errors_are_raised_together(spark):
    rows = [(k, 10.0 * k, 10.0 * k, 0.0, 5) for k in range(3)]
    with pytest.raises(validate.ValidationError) as e:
        validate.validate(cloud(spark, rows))
    assert len(str(e.value).split("\n")) == 3  # density, no ground, no CRS
    found = validate.validate(cloud(spark, [(0, 0.0, 0.0, 0.0, 2), (1, 1.0, 1.0, 0.0, 2)]), default_crs="local", raise_on_error=False)
    assert [f[1] for f in found] == ["crs", "density", "other"] and found[0][0] == "warning"
    with pytest.raises(validate.ValidationError):
        validate.validate(None)
    with pytest.raises(validate.ValidationError):
        validate.validate(cloud(spark, rows).drop("classification"), "crs")


def test_grid_edges(spark):
    g = GridSpec.from_points(cloud(spark, [(0, 0.0, 0.0, 0.0, 2), (1, 1.0, 0.5, 0.0, 2)]), 0.25)
    assert (g.width, g.height, g.y_max) == (5, 3, 0.75)
    from pyspark.sql import functions as F

    row, col = g.cell_of(F.col("x"), F.col("y"))
    got = cloud(spark, [(0, 0.0, 0.0, 0.0, 2), (1, 1.0, 0.5, 0.0, 2), (2, 0.25, 0.25, 0.0, 2)]).select("point_id", row.alias("r"), col.alias("c")).collect()
    assert {tuple(r) for r in got} == {(0, 2, 0), (1, 0, 4), (2, 1, 1)}
    assert g.all_cells(spark).count() == 15


def brute(rows, probes, k, dims):
    out = set()
    at = {"x": 1, "y": 2, "z": 3}
    for p in probes:
        near = sorted((sum((p[at[d]] - q[at[d]]) ** 2 for d in dims), q[0]) for q in rows if q[0] != p[0])[:k]
        out |= {(p[0], n + 1, round(d, 9), i) for n, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize("edge", [None, 0.05, 500.0])
def test_nearest_is_exact_for_any_bucket(spark, rows, edge):
    df = cloud(spark, rows)
    got = neighbours.nearest(df, df, 8, ["x", "y", "z"], edge=edge).collect()
    assert {(r["point_id"], r["rank"], round(r["d2"], 9), r["near_id"]) for r in got} == brute(rows, rows, 8, "xyz")


def test_fewer_points_than_neighbours(spark):
    rows = [(k, float(k), 0.0, 0.0, 2) for k in range(3)]
    df = cloud(spark, rows)
    assert neighbours.nearest(df, df, 8, ["x", "y", "z"]).count() == 6
    assert neighbours.nearest(df.limit(0), df, 8, ["x", "y", "z"]).count() == 0
    assert neighbours.nearest(df, df.limit(0), 1, ["x", "y"], payload="z").count() == 0


def test_height_above_ground(spark, rows):
    ground = [r for r in rows if r[4] == 2]
    want = {}
    for i, x, y, z, c in rows:
        near = min(((x - q[1]) ** 2 + (y - q[2]) ** 2, q[0], q[3]) for q in ground)
        want[i] = 0.0 if c == 2 else z - near[2]
    got = {r["point_id"]: r["hag"] for r in neighbours.height_above_ground(cloud(spark, rows)).collect()}
    assert got == pytest.approx(want)
    near = {r["point_id"]: r["hag"] for r in neighbours.height_above_ground(cloud(spark, rows), max_distance=50.0).collect()}
    assert near[601] is None and near[600] == pytest.approx(want[600])
    inside = {r["point_id"]: r["hag"] for r in neighbours.height_above_ground(cloud(spark, rows), extrapolate=False).collect()}
    assert inside[601] == 0.0


def test_isolated_points_are_outliers(spark, rows):
    got = neighbours.flag_outliers(cloud(spark, rows))
    flagged = {r["point_id"]: r["classification"] for r in got.where("is_outlier").collect()}
    assert flagged == {600: 7, 601: 7} or flagged == {601: 7}
    assert got.count() == len(rows) and got.where("mean_dist IS NULL").count() == 0
    population = neighbours.outlier_stats(neighbours.mean_distances(cloud(spark, rows)), stddev="population").first()
    assert population["stddev"] < neighbours.outlier_stats(neighbours.mean_distances(cloud(spark, rows))).first()["stddev"]


def test_stray_points_cost_cells_not_the_cloud(spark, monkeypatch):
    """Points far from a dense cloud, in several directions and heights: exact, and no level of the pyramid is skipped."""
    monkeypatch.setattr(neighbours, "TOP", 4)
    r = random.Random(13)
    rows = [(k, r.random() * 50, r.random() * 50, r.random(), 2) for k in range(3000)]
    rows += [(5000 + k, *at, 2) for k, at in enumerate([(9e4, 1.0, 0.0), (-2e3, -2e3, 0.5), (25.0, 25.0, 4e3), (9e4, 9e4, 1.0)])]
    got = {}
    for f in neighbours.nearest(cloud(spark, rows), cloud(spark, rows), 5, ["x", "y", "z"]).collect():
        got.setdefault(f["point_id"], []).append((f["rank"], f["near_id"]))
    assert len(got) == len(rows)
    for p in rows[:200] + rows[-4:]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p[1:4], q[1:4])), q[0]) for q in rows if q[0] != p[0])[:5]
        assert sorted(got[p[0]]) == [(k + 1, q) for k, (_, q) in enumerate(near)]


def test_blocks_follow_the_occupied_area(spark):
    r = random.Random(17)
    rows = [(k, r.random() * 10, r.random() * 10, 0.0, 2) for k in range(4000)] + [(9000, 1e6, 1e6, 0.0, 2)]
    edge = neighbours._block_edge(cloud(spark, rows), "x", "y", len(rows), 64)
    held = neighbours._cells(cloud(spark, rows), "x", "y", edge).groupBy("bx", "by").count().agg({"count": "max"}).first()[0]
    assert held <= 1024


def test_neighbours_are_not_kept_between_jobs(spark, rows, monkeypatch):
    """No table on disk has more rows than the cloud, whatever k; so no query needs disk for k rows a point."""
    sizes = []

    def noted(df, label="table", codec="snappy", own=neighbours.written):
        table = own(df, label, codec)
        sizes.append((label, table.count()))
        return table

    monkeypatch.setattr(neighbours, "written", noted)
    near = neighbours.nearest(cloud(spark, rows), cloud(spark, rows), 8, ["x", "y", "z"])
    assert near.count() == 8 * len(rows)
    assert neighbours.flag_outliers(cloud(spark, rows)).count() == len(rows)
    assert sizes and all(n <= len(rows) for label, n in sizes if label not in ("neighbours", "near-cells"))
    assert sum(n for label, n in sizes if label == "neighbours") < 8 * len(rows) / 2  # of stray points only


def test_points_without_a_place_or_numbers_keep_their_row(spark, rows):
    from pyspark.sql import functions as F

    lost = [(9000, None, 1.0, 1.0, 2), (9001, 1.0, float("nan"), 1.0, 5)]
    df = cloud(spark, rows + lost).withColumn("name", F.concat(F.lit("p"), F.col("point_id"))).withColumn("note", F.when(F.col("point_id") % 3 == 0, F.col("point_id")))
    got = {r["point_id"]: r for r in neighbours.flag_outliers(df).collect()}
    plain = {r["point_id"]: r for r in neighbours.flag_outliers(cloud(spark, rows)).collect()}
    assert len(got) == len(rows) + 2 and neighbours.flag_outliers(df).columns == [*df.columns, "mean_dist", "is_outlier"]
    assert all(got[i]["mean_dist"] is None and not got[i]["is_outlier"] for i in (9000, 9001))
    assert all(got[i]["mean_dist"] == pytest.approx(r["mean_dist"]) and got[i]["is_outlier"] == r["is_outlier"] for i, r in plain.items())
    assert all(r["name"] == f"p{i}" and r["note"] == (i if i % 3 == 0 else None) for i, r in got.items())


def test_cells_are_aggregated_where_their_points_are(spark, rows, monkeypatch):
    """One shuffle, of points and not of their hits; the same cells for any block."""
    from groundswell.operators import rasterize

    df, grid = cloud(spark, rows).where("x < 100"), GridSpec.from_points(cloud(spark, rows).where("x < 100"), 0.25)
    made = rasterize.rasterize(df, grid, how="idw")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")  # printed from the end
    want = {(r["row"], r["col"]): r["value"] for r in made.collect()}
    monkeypatch.setattr(rasterize, "BLOCK", 3)
    got = {(r["row"], r["col"]): r["value"] for r in rasterize.rasterize(df, grid, how="idw").collect()}
    assert got == pytest.approx(want)


def test_tables_on_the_way_are_removed(spark):
    from groundswell import session
    from groundswell.plans import queries

    before = session.tables()

    def make(spark, _):
        return session.written(spark.range(3), "way").where("id > 0"), "grid"

    table, grid = queries.alone(make, spark, "", "end")
    assert session.tables() - before == {table.written_to} and grid == "grid"
    assert sorted(r[0] for r in table.collect()) == [1, 2]
    session.discard(table)


def test_missing_modules_are_named(monkeypatch):
    monkeypatch.setattr(validate.importlib.util, "find_spec", lambda name: None if name == "lazrs" else object())
    assert validate.tools() == {"onnxruntime": True, "lazrs": False, "zstandard": True}
    validate.need("onnxruntime")
    with pytest.raises(validate.ValidationError, match="lazrs"):
        validate.need("onnxruntime", "lazrs")


@pytest.mark.parametrize("kind", ["int64", "float64", "float32"])
def test_packed_columns_come_back_and_are_small(kind):
    r = np.random.default_rng(3)
    known = r.random(4000) < 0.9
    for values in (r.integers(-(2**40), 2**40, 4000), np.sort(r.integers(0, 2**52, 4000)), r.integers(0, 8000, 4000), np.full(4000, 7), np.array([-(2**62), 2**62]), np.array([5])):
        values = values.astype(kind)
        for mask in (None, known[: len(values)]):
            got, there = neighbours._unpack(neighbours._pack(values, mask), len(values))
            assert got.dtype == values.dtype and np.array_equal(got, values)
            assert there is None or np.array_equal(there, mask)
    assert len(neighbours._pack(r.integers(0, 8000, 4000).astype(kind), None)) < 1.9 * 4000
    assert len(neighbours._pack(np.sort(r.integers(0, 2**52, 4000)), None)) < 6 * 4000
    odd = np.array([-0.0, np.nan, np.inf, 0.5, 2.0**60]).astype("float32" if kind == "float32" else "float64")
    assert neighbours._unpack(neighbours._pack(odd, None), 5)[0].tobytes() == odd.tobytes()


def test_flags_keep_only_what_is_asked_for(spark, rows, monkeypatch):
    """Of a point that has its neighbours no place is kept on disk unless asked for."""
    held = {}

    def noted(df, label="table", codec="snappy", own=neighbours.written):
        held[label] = table = own(df, label, codec)
        return table

    monkeypatch.setattr(neighbours, "written", noted)
    few = neighbours.flag_outliers(cloud(spark, rows), columns=["point_id", "classification"])
    assert few.columns == ["point_id", "classification", "mean_dist", "is_outlier"]
    assert held["each"].where("done AND (x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL)").count() == 0
    want = {r["point_id"]: (r["classification"], r["is_outlier"], r["mean_dist"]) for r in neighbours.flag_outliers(cloud(spark, rows)).collect()}
    assert {r["point_id"]: (r["classification"], r["is_outlier"], r["mean_dist"]) for r in few.collect()} == want


def test_a_stage_list_keeps_no_copy_of_its_table(spark, rows, tmp_path, monkeypatch):
    from groundswell.plans import stages

    cloud(spark, rows).write.parquet(str(tmp_path / "cloud"))
    labels = []

    def noted(df, label="table", codec="snappy", own=neighbours.written):
        labels.append(label)
        return own(df, label, codec)

    monkeypatch.setattr(neighbours, "written", noted)
    chain = [{"type": "readers.parquet", "filename": str(tmp_path / "cloud")}, {"type": "filters.outlier", "mean_k": 8}]
    assert stages.run(None, chain, spark=spark)[0].count() == len(rows)
    assert "each" in labels and "points" not in labels


def test_bands_leave_one_table(spark):
    """What reads the stacked bands finds them made, and nothing else of their making on disk."""
    import os

    from groundswell import session
    from groundswell.plans import queries

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    before = session.tables()
    table, spec = queries.stacked(spark, folder)
    assert session.tables() - before == {table.written_to}
    assert table.count() == spec.width * spec.height
    session.discard(table)
