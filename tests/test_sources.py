"""Readers, writers, resume and the streaming run."""

import io
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stemline.config import Features, Watershed
from stemline.plans import flows
from stemline.schema import POINTS
from stemline.sources import features as stored
from stemline.sources import archives, las, tables
from stemline.streaming import ingest


def las_bytes(n=7):
    extra = bytearray(192)
    extra[2] = 5
    extra[4:10] = b"treeID"
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, 192, b"") + bytes(extra)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HIIBHI", head, 94, 227, 227 + len(vlr), 1, 0, 24, n)
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.01)
    struct.pack_into("<3d", head, 155, 100.0, 0.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBHI", i * 100, 0, 50, i, 1 | 2 << 3, 4, 0, 0, 0, i) for i in range(n))
    return bytes(head) + vlr + body


def test_las_source(spark, tmp_path):
    (tmp_path / "SITE").mkdir()
    (tmp_path / "SITE" / "one.las").write_bytes(las_bytes())
    spark.dataSource.register(las.LasSource)
    got = spark.read.format("las").option("path", str(tmp_path)).load().orderBy("point_id").collect()
    assert len(got) == 7 and got[3].plot == "SITE__one" and got[3].x == 103.0 and got[3].tree_id == 3
    assert (got[3].return_number, got[3].number_of_returns, got[3].classification) == (1, 2, 4)
    (tmp_path / "bad.las").write_bytes(b"nope" * 100)
    with pytest.raises(ValueError):
        las.header(str(tmp_path / "bad.las"))


def test_las_ranges_plots_and_boxes(spark, tmp_path, monkeypatch):
    (tmp_path / "SITE").mkdir()
    for name, shift in (("near", 0.0), ("far", 1000.0)):
        pdf = pd.DataFrame({"x": shift + np.arange(50), "y": 0.0, "z": 1.0, "intensity": 1.0, "classification": 2, "tree_id": np.arange(50), "return_number": 1, "number_of_returns": 1})
        (tmp_path / "SITE" / f"{name}.las").write_bytes(las.encode(pdf))
    (tmp_path / "SITE" / "bare.las").write_bytes(las_bytes())  # no box in its header, x from 100
    monkeypatch.setattr(las, "BYTES", 100)
    reader = las.LasReader(str(tmp_path))
    ids = [i for part in reader.partitions() if "near" in part.path for batch in reader.read(part) for i in batch.column("point_id").to_pylist()]
    assert ids == list(range(50))
    reader = las.LasReader(f"file://{tmp_path}", ["SITE__far", "SITE__near"], {"x": (1010, 1012)})
    parts = reader.partitions()
    assert {part.path.rsplit("/")[-1] for part in parts} == {"far.las", "near.las"}
    read = [(part.path, batch.column("x").to_pylist()) for part in parts for batch in reader.read(part) if batch.num_rows]
    assert {path.rsplit("/")[-1] for path, _ in read} == {"far.las"} and sorted(x for _, xs in read for x in xs) == [1010.0, 1011.0, 1012.0]
    root = str(tmp_path)
    cloud, window = las.load(spark, root), las.load(spark, root, box={"x": (1010, 1012)})
    assert (window.count(), cloud.count(), cloud.where("x IN (3, 1003)").count(), window.join(cloud, ["plot", "point_id"]).count()) == (3, 107, 2, 3)
    assert las.load(spark, root, ["SITE__bare"], {"x": (101, 102.5)}).count() == 2
    assert las.load(spark, root, []).count() == 0 and las.load(spark, root, ["none"]).count() == 0


def test_las_by_spark_and_round_trip(spark, tmp_path):
    (tmp_path / "SITE").mkdir()
    pdf = pd.DataFrame({"x": [1.5, -2.25], "y": [0.0, 3.0], "z": [7.01, 8.0], "intensity": [3.0, 4.0], "classification": [2, 5], "tree_id": [0, 9], "return_number": [1, 2], "number_of_returns": [2, 2]})
    (tmp_path / "SITE" / "two.las").write_bytes(las.encode(pdf))
    got = las.scan(spark, str(tmp_path)).orderBy("point_id").toPandas()
    assert got["plot"].tolist() == ["SITE__two"] * 2 and np.allclose(got[["x", "y", "z"]], pdf[["x", "y", "z"]])
    assert (got[list(pdf.columns[3:])].to_numpy() == pdf[list(pdf.columns[3:])].to_numpy()).all()
    (tmp_path / "SITE" / "bad.las").write_bytes(b"nope" * 100)
    with pytest.raises(Exception, match="not a LAS file"):
        las.scan(spark, str(tmp_path)).count()


def test_arrays_in_archives(spark, tmp_path):
    held = io.BytesIO()
    np.savez(held, semantic_pred=np.array([1, 0, 1]), instance_ids=np.array([4, 0, 5]))
    with zipfile.ZipFile(tmp_path / "some.zip", "w") as z:
        z.writestr("predictions/rf/S__a_instances.npz", held.getvalue())
        z.writestr("readme.txt", "no array")
    assert {r.member for r in archives.members(spark, str(tmp_path)).collect()} == {"predictions/rf/S__a_instances.npz", "readme.txt"}
    got = archives.predictions(spark, str(tmp_path), "rf", "S__a").orderBy("position").collect()
    assert [(r.semantic_pred, r.instance_ids) for r in got] == [(1, 4), (0, 0), (1, 5)]
    assert archives.predictions(spark, str(tmp_path), "rf", "S__b").count() == 0


def test_manifest_and_listing(spark, tmp_path):
    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "x.las").write_bytes(b"LASF")
    (tmp_path / "m.csv").write_text("path,folder,split\nA/x.las, A ,test\nA/y.las,A,dev\nB/z.las,B,dev\n")
    m = tables.manifest(spark, str(tmp_path / "m.csv"), ("B",))
    assert m.count() == 2
    assert [r.path for r in tables.present(m, tables.files(spark, str(tmp_path))).collect()] == ["A/x.las"]
    assert {r.split: r.n for r in tables.split_counts(m).collect()} == {"test": 1, "dev": 1}


def test_metric_tables(spark, tmp_path):
    rows = spark.createDataFrame([("S/p", 0.5, 0.5, 0.5, 0.5)], "plot string, f1 double, precision double, recall double, coverage double")
    tables.write_metrics(rows, str(tmp_path / "rf"))
    m = tables.metrics(spark, {"rf": str(tmp_path / "rf"), "none": str(tmp_path / "missing")})
    assert tables.checked(m).first().institution == "S"
    with pytest.raises(ValueError):
        tables.checked(m.drop("f1"))
    with pytest.raises(FileNotFoundError):
        tables.metrics(spark, {"none": str(tmp_path / "missing")})


def test_best_params(spark):
    new = spark.createDataFrame([("rf", 0.2, 0.5, 1.0, None, 0.4)], "method string, voxel_size double, gaussian_sigma double, min_crown_radius_m double, top_band_m double, mean_f1 double")
    old = new.withColumn("method", F.lit("baseline")).unionByName(new.withColumn("voxel_size", F.lit(9.0)))
    both = tables.upsert_best(old, new)
    assert both.count() == 2 and tables.best_params(both, "rf", Watershed()).voxel_size == 0.2
    with pytest.raises(tables.MissingBestParamsError):
        tables.best_params(both, "pointnet2")
    with pytest.raises(tables.MissingBestParamsError):
        tables.best_params(None, "rf")


def cloud():
    rng = np.random.default_rng(8)
    rows = []
    for plot in ("S__a", "S__b"):
        ground = [(plot, x, y, 0.0, 2, 0) for x in np.arange(-3, 12, 0.5) for y in np.arange(-3, 4, 0.5)]
        for tree, cx in ((1, 0.0), (2, 8.0)):
            h = rng.uniform(1, 6, 500)
            a, r = rng.uniform(0, 2 * np.pi, 500), (6.5 - h) / 6 * rng.uniform(0, 1.2, 500)
            rows += [(plot, cx + x, y, z, 5, tree) for x, y, z in zip(r * np.cos(a), r * np.sin(a), h)]
        rows += ground
    pdf = pd.DataFrame(rows, columns=["plot", "x", "y", "z", "classification", "tree_id"])
    return pdf.assign(institution="S", point_id=range(len(pdf)), intensity=1.0, return_number=1, number_of_returns=1)[POINTS.names]


def test_flow_end_to_end_with_resume_and_stream(spark, tmp_path):
    raw = spark.createDataFrame(cloud(), POINTS)
    ready = flows.prepare(raw).persist()
    assert ready.where("classification = 5").agg(F.avg(F.abs(F.col("hag") - F.col("z")))).first()[0] < 0.2
    pred = ready.select(F.lit("rf").alias("method"), "plot", "point_id", F.when(F.col("classification") == 5, 1).otherwise(0).alias("semantic_pred"), F.lit(0).alias("instance_id"))
    params = spark.createDataFrame([("rf", 0.4, 0.5, 2.0, None, 1.0)], "method string, voxel_size double, gaussian_sigma double, min_crown_radius_m double, top_band_m double, mean_f1 double")
    path = str(tmp_path / "predictions")
    for _ in range(2):
        scored = {r.plot: r for r in flows.run_stage(ready, "rf", path, params, pred).collect()}
        assert len(scored) == 2 and scored["S__a"].f1 == 1.0 and scored["S__a"].sem_accuracy == 1.0
    assert tables.predictions(spark, path, "rf", "S__a").count() == raw.where("plot = 'S__a'").count()
    with pytest.raises(ValueError):
        flows.filtered(ready, "rf", None)
    summary, best = flows.tune(ready, "rf_density", pred, {"voxel_size": (0.4,), "gaussian_sigma": (0.5,), "min_crown_radius_m": (2.0,), "top_band_m": (2.0,)})
    assert best.first().mean_f1 == 1.0

    raw.where("plot = 'S__b'").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "streamed")
    wide = Watershed(voxel_size=0.4, min_crown_radius_m=2.0)
    ingest.on_arrival(spark, str(tmp_path / "in"), out, str(tmp_path / "state"), lambda p: flows.instances(flows.prepare(p), "baseline", None, wide)).awaitTermination()
    assert tables.predictions(spark, out).count() == raw.where("plot = 'S__b'").count()
    ready.unpersist()


def test_feature_store_recomputes_only_what_is_missing(spark, tmp_path):
    p = spark.createDataFrame(pd.DataFrame({"plot": ["a", "a", "b"], "point_id": [0, 1, 0], "v": 1.0}))
    seen = []

    def compute(points, cfg):
        seen.append(points.count())
        return points

    assert stored.cached(p.where("plot = 'a'"), str(tmp_path / "f"), Features(), compute).count() == 2
    assert stored.cached(p, str(tmp_path / "f"), Features(), compute).count() == 3
    assert seen == [2, 1]
