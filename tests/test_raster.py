"""Rasters, kernels, bands, tiles, models and files against small NumPy versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell import functions as fn
from groundswell.model import BANDS, GridSpec, ModelConfig
from groundswell.operators import bands, tiling
from groundswell.operators.focal import focal
from groundswell.operators.predict import predict
from groundswell.operators.rasterize import fill_gaps, rasterize
from groundswell.plans import stages
from groundswell.plans.pipelines import PIPELINES, infer
from groundswell.plans.surrogate import mean_model
from groundswell.sources import geotiff, las
from groundswell.sources.points import merge, read_points
from groundswell.sources.raster import read_raster, write_raster


def cells_of(spark, a, name="value"):
    rows = [(int(r), int(c), float(a[r, c])) for r, c in np.argwhere(~np.isnan(a))]
    return spark.createDataFrame(rows, f"row int, col int, {name} double").repartition(3)


def array_of(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def grid_of(a):
    return GridSpec(0.0, 0.0, 1.0, a.shape[1], a.shape[0])


@pytest.mark.parametrize("shape, block", [((30, 41), 16), ((7, 5), 16), ((3, 2), 112), ((33, 17), 16)])
def test_focal_median_mirrors(spark, shape, block):
    a = np.random.default_rng(1).random(shape)
    a[1, 1] = np.nan
    filled = np.nan_to_num(a)
    side = lambda n: np.where((i := np.mod(np.arange(-5, n + 4), 2 * n)) < n, i, 2 * n - 1 - i)
    wide = filled[np.ix_(side(shape[0]), side(shape[1]))]
    want = np.array([[np.sort(wide[r : r + 10, c : c + 10].ravel())[50] for c in range(shape[1])] for r in range(shape[0])])
    assert np.array_equal(array_of(focal(cells_of(spark, a), grid_of(a), block=block), shape), want)


@pytest.mark.parametrize("window", [3, 12])
def test_gaps_are_filled_within_the_window(spark, window):
    a = np.full((20, 45), np.nan)
    a[4, 3], a[5, 9], a[18, 2] = 7.0, 9.0, 1.0
    got = array_of(fill_gaps(cells_of(spark, a), grid_of(a), window, block=16), a.shape)
    for r in range(20):
        for c in range(45):
            near = [(max(abs(r - i), abs(c - j)), v) for i, j, v in ((4, 3, 7.0), (5, 9, 9.0), (18, 2, 1.0)) if max(abs(r - i), abs(c - j)) <= window]
            if near and near[0][0] == 0 or not math.isnan(a[r, c]):
                assert got[r, c] == a[r, c]
            elif near:
                assert got[r, c] == pytest.approx(sum(v / d for d, v in near) / sum(1 / d for d, _ in near))
            else:
                assert math.isnan(got[r, c])


def test_disc_and_exact_hits(spark):
    g = GridSpec(0.0, 0.0, 1.0, 3, 3)
    p = spark.createDataFrame([(1, 0.5, 0.5, 4.0), (2, 0.5, 0.5, 6.0), (3, 1.4, 0.5, 9.0)], "point_id long, x double, y double, z double")
    got = array_of(rasterize(p, g), (3, 3))
    assert got[2, 0] == 4.0  # on the centre, the lesser id wins
    d = [(1.0, 4.0), (1.0, 6.0), (0.1, 9.0)]
    assert got[2, 1] == pytest.approx(sum(z / x**6 for x, z in d) / sum(1 / x**6 for x, _ in d))
    count = array_of(rasterize(p, g, how="count"), (3, 3))
    assert count[2, 0] == 3 and count[1, 1] == 1 and math.isnan(count[0, 0])  # a distance of sqrt(2) is out
    assert np.nansum(array_of(rasterize(p, g, how="count", binning="bin"), (3, 3))) == 3
    assert array_of(rasterize(p, g, how="max", radius=2.5), (3, 3))[0, 0] == 9.0


def test_vegetation_density_branches(spark):
    rows = [(0.0, 0.0), (0.0, 5.0), (1.0, 20.0), (6.0, 5.0), (2.0, 4.0)]
    got = spark.createDataFrame(rows, "low double, high double").select(fn.vegetation_density(F.col("low"), F.col("high"))).collect()
    assert [r[0] for r in got] == [0.1, 0.1, 0.05, 1.0, 0.5]


def test_exact_percentiles_and_normalisation(spark):
    r = np.random.default_rng(3)
    a = {b: r.normal(size=(40, 30)) * 10**k for k, b in enumerate(BANDS)}
    a["chm"][:] = 5.0
    a["vdi"][:] = np.nan
    a["mrm"][r.random((40, 30)) < 0.3] = np.nan
    wide = bands.stack({b: cells_of(spark, v) if not np.isnan(v).all() else cells_of(spark, np.full((1, 1), 1.0)).limit(0) for b, v in a.items()})
    got = bands.percentiles(wide, BANDS, [0.01, 0.5, 0.99], bins=7, least=5)
    for b, v in a.items():
        v = v[~np.isnan(v)]
        assert got[b] == ([None] * 3 if not len(v) else pytest.approx(np.percentile(v, [1, 50, 99])))
    made = bands.normalize(wide)
    assert np.nanmax(np.abs(array_of(made, (40, 30), "chm"))) == 0
    assert np.isnan(array_of(made, (40, 30), "vdi")).all()
    p1, p99 = np.percentile(a["dtm"], [1, 99])
    assert np.allclose(array_of(made, (40, 30), "dtm"), np.clip((a["dtm"] - p1) / (p99 - p1 + 1e-10), 0, 1))


def test_shapes_must_agree(spark):
    one = cells_of(spark, np.ones((2, 2)))
    with pytest.raises(ValueError):
        bands.align(one, one, (2, 2), (2, 3))
    with pytest.raises(ValueError):
        bands.stack({"a": one, "b": one}, [(2, 2), (2, 3)])
    assert bands.align(one, one, (2, 2), (1, 3), "reference")[2] == (1, 2)


def test_tile_starts():
    assert [len(tiling.starts(n)) for n in (112, 113, 224, 225, 4000)] == [1, 1, 1, 2, 35]
    with pytest.raises(ValueError):
        tiling.starts(112, strict=True)
    assert tiling.padding(225) == 111


def test_weights(spark):
    w = tiling.weights_array(224)
    assert w.mean() == pytest.approx(1.0) and round(w.min(), 4) == 0.0143 and round(w.max(), 3) == 3.185
    assert np.allclose(array_of(tiling.pyramid_weights(spark, 16).withColumnsRenamed({"i": "row", "j": "col", "w": "value"}), (16, 16)), tiling.weights_array(16))


@pytest.mark.parametrize("op", tiling.AUGMENTATIONS)
def test_augmentations_are_inverted(spark, op):
    a = np.arange(35.0).reshape(5, 7)
    there = tiling.augment(cells_of(spark, a), op, 5, 7)
    turned = {"identity": a, "rot90": np.rot90(a), "flipud": a[::-1]}[op]
    assert np.array_equal(array_of(there, turned.shape), turned)
    assert np.array_equal(array_of(tiling.deaugment(there, op, 5, 7), a.shape), a)


def test_padding_mirrors_without_the_edge(spark):
    a = np.random.default_rng(2).random((37, 29))
    got = tiling.reflect_pad(cells_of(spark, a), 37, 29, 16, 8)
    down, right = tiling.padding(37, 16, 8), tiling.padding(29, 16, 8)
    want = np.pad(a, ((0, down), (0, right)), mode="reflect")
    assert np.array_equal(array_of(got, want.shape), want)


def expected(a, model, tile, stride, border=0):
    """The whole procedure with dense arrays, (bands, h, w)."""
    out, total = tile - 2 * border, 0
    w = tiling.weights_array(out)
    for turn, back in ((lambda x: x, lambda x: x), (lambda x: np.rot90(x, axes=(1, 2)), lambda x: np.rot90(x, -1)), (lambda x: x[:, ::-1], lambda x: x[::-1])):
        b = turn(a)
        h, v = b.shape[1:]
        ys, xs = tiling.starts(h, tile, stride, border), tiling.starts(v, tile, stride, border)
        b = np.pad(b, ((0, 0), (border, tiling.padding(h, tile, stride, border)), (border, tiling.padding(v, tile, stride, border))), mode="reflect")
        up, down = np.zeros(b.shape[1:]), np.full(b.shape[1:], 1e-7)
        for y in ys:
            for x in xs:
                p = model(b[None, :, y : y + tile, x : x + tile].astype(np.float32))[0, 0]
                p = p[border : tile - border, border : tile - border]
                up[y : y + out, x : x + out] += p * w
                down[y : y + out, x : x + out] += w
        total = total + back((up / down)[:h, :v])
    return total / 3


# Lambdas travel to workers by value; this module can't be imported there.
tile_mean = lambda a: np.broadcast_to(a.mean(axis=(1, 2, 3), keepdims=True), (len(a), 1, *a.shape[2:]))
band_mean = lambda a: a.mean(axis=1, keepdims=True)


@pytest.mark.parametrize("model, tile, stride, border", [(band_mean, 16, 8, 0), (tile_mean, 16, 8, 0), (tile_mean, 12, 4, 0), (tile_mean, 16, 8, 2)])
def test_segmentation(spark, model, tile, stride, border):
    a = np.random.default_rng(5).random((2, 37, 29))
    wide = bands.stack({"a": cells_of(spark, a[0]), "b": cells_of(spark, a[1])})
    got, run = tiling.segment(wide, grid_of(a[0]), model, ["a", "b"], tile, stride, drop_border=border, batch_size=1 + border)
    got = array_of(got, a.shape[1:], "p")
    want = expected(a, model, tile, stride, border)
    covered = ~np.isnan(got)
    assert np.allclose(got[covered], want[covered], atol=1e-5) and covered.mean() == 1.0
    assert run["prediction"] and run["time"] >= 0


def test_data_window(spark):
    a = np.zeros((40, 40))
    a[8:32, 4:30] = 0.5
    wide = bands.stack({b: cells_of(spark, a) for b in BANDS})
    got, run = infer(wide, grid_of(a), band_mean, ModelConfig(tile=16, stride=8), nodata=0.0)
    assert run["nodata_region"] == (8, 32, 4, 30)
    assert np.allclose(array_of(got, a.shape, "p"), a, atol=1e-5)
    assert tiling.data_window(wide, "dtm", 0.0, inclusive=False) == (8, 31, 4, 29)
    none, run = tiling.segment(wide.where("dtm = 0"), grid_of(a), band_mean, BANDS, 16, 8, nodata=0.0)
    assert none is None and not run["prediction"]


def test_onnx_models(spark):
    r = np.random.default_rng(6).random((6, 4 * 8 * 8))
    tiles = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(r)], "k int, data array<double>")
    got = {x["k"]: x["data"] for x in predict(tiles, mean_model(4, 8), 4, 8).collect()}
    for k, v in enumerate(r):
        assert np.allclose(got[k], v.reshape(4, 64).mean(axis=0), atol=1e-6)


def test_geotiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(8).random((2, 70, 33)).astype(np.float32)
    a[:, 3, 4] = 0
    g = GridSpec(100.0, 200.0, 0.25, 33, 70, 'LOCAL_CS["x"]', 0.0)
    back, spec, names = geotiff.decode(geotiff.encode(a, g, ["one", "two"]))
    assert np.array_equal(back, a) and spec == g and names == ["one", "two"]
    wide = bands.stack({"one": cells_of(spark, a[0].astype(float)), "two": cells_of(spark, a[1].astype(float))})
    for fmt, path in (("geotiff", f"{tmp_path}/a.tif"), ("parquet", f"{tmp_path}/a"), ("mosaic", f"{tmp_path}/m")):
        write_raster(wide, g, path, fmt, ["one", "two"], block=20)
        df, spec = read_raster(spark, path, fmt)
        assert spec.record() == g.record()
        assert np.allclose(np.nan_to_num(array_of(df, (70, 33), "one")), a[0])
    with open(f"{tmp_path}/a.tif", "rb") as f:
        assert np.array_equal(geotiff.decode(f.read())[0], a)
    sparse = wide.where("row > 64")  # strips without a cell are nodata
    write_raster(sparse, g, f"{tmp_path}/s.tif", "geotiff", ["one", "two"])
    assert read_raster(spark, f"{tmp_path}/s.tif", "geotiff", rows_at_once=10)[0].count() == sparse.count()
    with pytest.raises(ValueError):
        geotiff.decode(b"PK\3\4")


@pytest.mark.parametrize("planar", [True, False])
def test_deflated_strips_are_read(planar):
    import struct
    import zlib

    a = np.random.default_rng(3).integers(0, 999, (2, 10, 7)).astype("<i2")
    rows = [a[:, r : r + 4] for r in range(0, 10, 4)]
    step = lambda x: np.diff(x, axis=1, prepend=np.zeros_like(x[:, :1]))
    blocks = [step(part[b]) for b in range(2) for part in rows] if planar else [step(part.transpose(1, 2, 0)) for part in rows]
    strips = [zlib.compress(np.ascontiguousarray(b).tobytes()) for b in blocks]
    at = np.cumsum([0, *map(len, strips)])[:-1] + 8
    end = 8 + sum(map(len, strips))
    lists = struct.pack(f"<{len(at)}I", *at) + struct.pack(f"<{len(at)}I", *map(len, strips))
    tags = [(256, 3, 1, 7), (257, 3, 1, 10), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, len(at), end), (277, 3, 1, 2), (278, 3, 1, 4), (279, 4, len(at), end + 4 * len(at)), (284, 3, 1, 2 if planar else 1), (317, 3, 1, 2), (339, 3, 1, 2)]
    raw = struct.pack("<2sHI", b"II", 42, end + len(lists)) + b"".join(strips) + lists
    raw += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4
    assert np.array_equal(geotiff.decode(raw)[0], a)


def test_las_round_trip(spark, tmp_path):
    r = np.random.default_rng(9)
    x, y, z = (r.random(2500) * 100 for _ in range(3))
    codes = r.integers(1, 6, 2500)
    las.write(f"{tmp_path}/a.las", x, y, z, codes, crs_wkt='LOCAL_CS["x"]')
    spark.dataSource.register(las.LasSource)
    part = spark.read.format("las").option("records_per_partition", 700).load(f"{tmp_path}/a.las")
    assert part.rdd.getNumPartitions() == 4
    points, known = read_points(spark, f"PDAL://{tmp_path}/a.las", "las")
    assert known["crs"] == 'LOCAL_CS["x"]' and not known["findings"]
    got = points.orderBy("point_id").toPandas()
    assert np.allclose(got[["x", "y", "z"]], np.stack([x, y, z], axis=1), atol=6e-4) and got["classification"].tolist() == codes.tolist()
    assert merge(points, points).count() == 5000
    las.write(f"{tmp_path}/b.las", x[:10], y[:10], z[:10], codes[:10])
    for place in (f"{tmp_path}", f"file://{tmp_path}", f"{tmp_path}/*.las"):
        both = spark.read.format("las").load(place)
        assert both.count() == 2510 and both.select("point_id").distinct().count() == 2510


def test_compressed_clouds_need_their_module(tmp_path, monkeypatch):
    """The module's reader is asked for the right range; without it the error says what is missing."""
    import sys
    import types

    r = np.random.default_rng(4)
    x, y, z = (r.random(50) * 9 for _ in range(3))
    las.write(f"{tmp_path}/a.las", x, y, z, r.integers(1, 6, 50))
    raw = bytearray((tmp_path / "a.las").read_bytes())
    raw[104] |= 128
    (tmp_path / "a.laz").write_bytes(raw)
    head = las.header(f"{tmp_path}/a.laz")
    assert head.compressed and head.kind == 6
    monkeypatch.setitem(sys.modules, "lazrs", None)
    with pytest.raises(ValueError, match="lazrs"):
        las.records(f"{tmp_path}/a.laz", head, 0, 5)

    class Reader:
        def __init__(self, source, record):
            self.source, self.start = source, source.tell()

        def seek(self, k):
            self.source.seek(self.start + k * 30)

        def decompress_many(self, into):
            into[:] = self.source.read(len(into))

    monkeypatch.setitem(sys.modules, "lazrs", types.SimpleNamespace(LasZipDecompressor=Reader))
    assert np.allclose(las.records(f"{tmp_path}/a.laz", head, 7, 100)["x"], x[7:], atol=6e-4)


def test_stage_lists(spark):
    r = np.random.default_rng(10)
    rows = [(k, *(float(v) for v in r.random(2) * 5), float(r.random() * 2), int(2 + 3 * (k % 2))) for k in range(300)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, classification int")
    text = '["in.las", {"type": "filters.hag_nn"}, {"type": "filters.expression", "expression": "HeightAboveGround < 0.8 && Classification != 9"}, {"type": "writers.gdal", "filename": "o.tif", "resolution": 0.25, "output_type": "count", "dimension": "HeightAboveGround"}]'
    cells, grid = stages.run(points, stages.load(text), options={"writers.gdal": {"filename": None}})
    assert cells.count() and grid.res == 0.25
    left, _ = stages.run(points, stages.load('{"pipeline": [{"type": "filters.expression", "expression": "Classification == 2"}]}'))
    assert left.count() == 150
    with pytest.raises(ValueError):
        stages.run(points, [{"type": "filters.unknown"}])


@pytest.mark.parametrize("name", ["dtm", "chm", "low", "high"])
def test_packaged_stage_lists_read_and_write(spark, tmp_path, name):
    from groundswell.model import FILL_WINDOWS, GridSpec
    from groundswell.operators import neighbours
    from groundswell.operators.rasterize import fill_gaps, rasterize

    r = np.random.default_rng(12)
    x, y, z, codes = r.random(400) * 5, r.random(400) * 5, r.random(400) * 15, np.where(np.arange(400) % 2, 2, 5)
    las.write(f"{tmp_path}/in.las", x, y, z, codes)
    chain = [f"{tmp_path}/in.las", *stages.packaged(name)]
    cells, grid = stages.run(None, stages.load(json.dumps(chain)), spark=spark, options={"writers.gdal": {"filename": f"{tmp_path}/out.tif"}})
    points = read_points(spark, f"{tmp_path}/in.las", "las", default_crs="local")[0]
    if name == "dtm":
        own = neighbours.flag_outliers(points).where("classification = 2")
        value, how, power = "z", "idw", 6.0
    else:
        own = neighbours.height_above_ground(points)
        own = own.where({"chm": "true", "low": "hag < 0.8", "high": "hag <= 12"}[name])
        value, how, power = "hag", "max" if name == "chm" else "count", 1.0
    spec = GridSpec.from_points(own, 0.25)
    want = rasterize(own, spec, value, how, power)
    want = fill_gaps(want, spec, FILL_WINDOWS[name]) if how != "count" else want
    assert spec == grid and np.allclose(array_of(cells, (grid.height, grid.width), "value"), array_of(want, (grid.height, grid.width), "value"), equal_nan=True)
    back, _ = read_raster(spark, f"{tmp_path}/out.tif", "geotiff")
    assert np.allclose(np.nan_to_num(array_of(back, (grid.height, grid.width), "value")), np.nan_to_num(array_of(want, (grid.height, grid.width), "value")), atol=1e-4)


@pytest.mark.parametrize("policy", ["shared", "reference"])
def test_preprocess_then_infer(spark, policy):
    from groundswell.model import PreprocessOptions

    r = np.random.default_rng(11)
    corners = [(0.0, 0.0), (0.0, 6.0), (6.0, 0.0), (6.0, 6.0)]
    rows = [(k, *p, 0.0, 2) for k, p in enumerate(corners)] + [(10 + k, *p, 0.5, 5) for k, p in enumerate(corners)]
    rows += [(100 + k, *(float(v) for v in r.random(2) * 6), float(r.random() * (8 if k % 2 else 0.3)), 5 if k % 2 else 2) for k in range(900)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double, z double, classification int")
    seen = []
    wide, grid, findings = PIPELINES["preprocessing"](points, PreprocessOptions(grid_policy=policy), crs="local", progress=lambda k, s: seen.append(s) or True)
    assert (grid.width, grid.height) == (25, 25) and len(seen) == 8 and not findings
    for b in BANDS:
        a = array_of(wide, (25, 25), b)
        assert np.nanmin(a) >= 0 and np.nanmax(a) <= 1 and (policy == "reference" or not np.isnan(a).any())
    p, _ = infer(wide, grid, band_mean, ModelConfig(tile=16, stride=8))
    want = np.mean([np.nan_to_num(array_of(wide, (25, 25), b)) for b in BANDS], axis=0)
    assert np.allclose(array_of(p, (25, 25), "p"), want, atol=1e-5)
    assert PIPELINES["preprocessing"](points, crs="local", progress=lambda k, s: False)[0] is None


def test_streaming_intake(spark, tmp_path):
    from groundswell.streaming.intake import watch

    spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2)], "point_id long, x double, y double, z double, classification int").write.parquet(f"{tmp_path}/in")
    got = []
    watch(spark, f"{tmp_path}/in", lambda df, n: got.append(df.count()), f"{tmp_path}/state", once=True).awaitTermination(60)
    assert got == [1]
    r = np.random.default_rng(2)
    las.write(f"{tmp_path}/one.las", *(r.random(30) for _ in range(3)), np.full(30, 2))
    las.write(f"{tmp_path}/two.las", *(r.random(20) for _ in range(3)), np.full(20, 2))
    ids = []
    watch(spark, str(tmp_path), lambda df, n: ids.extend(r["point_id"] for r in df.collect()), f"{tmp_path}/las-state", once=True, fmt="las").awaitTermination(60)
    assert len(ids) == len(set(ids)) == 50


def test_groups_of_tiles(spark, monkeypatch):
    """Any group gives the same; a block goes to few groups, and tiles without any data are predicted like others."""
    a = np.zeros((2, 70, 53))
    a[:, 3:9, 4:11] = np.random.default_rng(6).random((2, 6, 7))
    some = [(r, c, float(a[0, r, c]), float(a[1, r, c])) for r in range(3, 9) for c in range(4, 11)]
    wide = spark.createDataFrame(some, "row int, col int, a double, b double")
    model = lambda x: 0.25 + np.broadcast_to(x.mean(axis=(1, 2, 3), keepdims=True), (len(x), 1, *x.shape[2:]))
    want = expected(a, model, 16, 8)
    for group, cells in ((1, 1), (2, 1), (4, 448)):
        monkeypatch.setattr(tiling, "GROUP", group)
        monkeypatch.setattr(tiling, "GROUP_CELLS", cells)
        got = array_of(tiling.segment(wide, grid_of(a[0]), model, ["a", "b"], 16, 8, batch_size=3)[0], a.shape[1:], "p")
        assert np.allclose(got, want, atol=1e-5)
    monkeypatch.undo()
    for tile, stride in ((32, 16), (224, 112)):
        sides = [tiling._sides(op, 3200, 3100, tile, stride, 0, stride, max(tiling.GROUP, tiling.GROUP_CELLS // stride) * stride) for op in tiling.AUGMENTATIONS]
        sent = [sum(len(set().union(*(s[k].needed[b] for s in sides))) for b in range(len(sides[0][k].over))) / len(sides[0][k].over) for k in (0, 1)]
        assert sent[0] * sent[1] < 4  # it was 12, one for each tile of each augmentation
