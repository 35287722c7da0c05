"""Files written here, read back through the sources and sinks."""
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scangrid.operators import checks, motion, predict
from scangrid.sources import scans, sinks, taxonomy


@pytest.fixture()
def dataset(tmp_path):
    base = tmp_path / "sequences" / "08"
    (base / "sweeps").mkdir(parents=True)
    (base / "labels").mkdir()
    rng = np.random.default_rng(42)
    for frame in range(3):
        rng.uniform(-5, 5, (100 + frame, 4)).astype("<f4").tofile(base / "sweeps" / f"{frame:06d}.bin")
        np.full(100 + frame, (7 << 16) | 48, "<u4").tofile(base / "labels" / f"{frame:06d}.label")
    (base / "poses.txt").write_text("".join(f"1 0 0 {i} 0 1 0 0 0 0 1 0\n" for i in range(3)))
    (base / "calib.txt").write_text("P0: 1 2 3\nTr: 0 -1 0 0.5 0 0 -1 0 1 0 0 0\n")
    return tmp_path


def test_sweeps_labels_and_poses(spark, dataset):
    pts = scans.scan_points(scans.binary_files(spark, str(dataset), "*.bin"))
    n = {r.frame_id: r["count"] for r in pts.groupBy("frame_id").count().collect()}
    assert n == {0: 100, 1: 101, 2: 102}
    raw = np.fromfile(dataset / "sequences/08/sweeps/000001.bin", "<f4").reshape(-1, 4)
    first = pts.where("frame_id = 1 and point_id = 5").first()
    assert first.sequence == "08" and np.allclose([first.x, first.y, first.z, first.intensity], raw[5])
    lab = taxonomy.decode_labels(scans.scan_labels(scans.binary_files(spark, str(dataset), "*.label")))
    assert {(r.semantic, r.label, r.macro) for r in lab.select("semantic", "label", "macro").distinct().collect()} \
        == {(48, "sidewalk", 1)}
    poses = motion.lidar_poses(scans.scan_poses(spark, str(dataset)), scans.scan_calib(spark, str(dataset)))
    got = poses.where("frame_id = 2").first()
    assert (got.t01, got.t03, got.t20) == (-1.0, 2.5, 1.0)


def test_bad_length_is_an_error(spark, tmp_path):
    (tmp_path / "000000.bin").write_bytes(b"123456")
    with pytest.raises(Exception, match="multiple"):
        scans.scan_points(scans.binary_files(spark, str(tmp_path), "*.bin")).count()


def test_ply_and_pcd(spark, tmp_path):
    xyz = np.array([(1, 2, 3), (4, 5, 6)], "<f4")
    (tmp_path / "a1.ply").write_bytes(
        b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\n"
        b"property float z\nend_header\n" + xyz.tobytes())
    (tmp_path / "a2.pcd").write_text("VERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\n"
                                     "COUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA ascii\n1 2 3 0.5\n4 5 6 0.25\n")
    rows = scans.scan_points(scans.binary_files(spark, str(tmp_path))).orderBy("frame_id", "point_id").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(1, 2, 3), (4, 5, 6)] * 2
    assert [r.intensity for r in rows] == [0, 0, .5, .25]


def test_archives_in_natural_order_and_quarantine(spark, tmp_path):
    data = np.zeros((3, 4), "<f4").tobytes()
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        for i in (10, 9, 1):
            z.writestr(f"scan{i}.bin", data * i)
        z.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../escape.bin", b"bad")
    pts, quarantine = scans.scan_archive(spark, str(tmp_path))
    assert [r["count"] for r in pts.groupBy("frame_id").count().orderBy("frame_id").collect()] == [3, 27, 30]
    assert [r.finding for r in quarantine.collect()] == ["unsafe member path"]


def test_taxonomy_is_complete(spark):
    table = {r.label: r.macro for r in taxonomy.class_mapping_table(spark).collect()}
    assert len(table) == 34
    for name, macro in table.items():
        if name.startswith("moving-") or name in ("car", "bus", "on-rails", "person", "truck"):
            assert macro == 3
    assert not set(taxonomy.SPLITS["train"]) & set(taxonomy.SPLITS["valid"])


def test_prediction_and_block_tables(spark, cloud, tmp_path):
    sig = predict.model_signature("rules", {"n": 4096})
    preds = predict.apply_predictor(cloud([(1, 1, -1.7, 0), (1, 1, 0, 0)]), signature=sig)
    sinks.write_predictions(preds, str(tmp_path / "p"))
    back = sinks.read_predictions(spark, str(tmp_path / "p"), sig)
    assert sorted(r.pred for r in back.collect()) == [0, 2]
    t = spark.createDataFrame([("train", "00", 1), ("train", "01", 1), ("valid", "08", 2)],
                              "split string, sequence string, frame_id int")
    sinks.write_blocks(t, str(tmp_path / "b"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_blocks(t, str(tmp_path / "b"))
    assert sinks.read_blocks(spark, str(tmp_path / "b"), "train").count() == 2
    got = {r.split: (r.blocks, r.sequences) for r in sinks.block_inventory(t).collect()}
    assert got == {"train": (2, 2), "valid": (1, 1)}


def test_evidence_and_curve(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"frames": 3,\n "per_frame": [1, 2]}')
    schema = "frames int, per_frame array<int>"
    assert sinks.read_evidence(spark, str(tmp_path / "e.json"), schema).collect() == [(3,)]
    assert sinks.read_evidence(spark, str(tmp_path / "no.json"), schema, '{"frames": 0}').collect() == [(0,)]
    (tmp_path / "c.csv").write_text("epoch,train_loss,val_miou,elapsed_seconds,steps,complete_epoch\n1,.5,.7,9,10,True\n")
    assert sinks.read_curve(spark, str(tmp_path / "c.csv")).first().val_miou == .7


def test_frame_documents_by_job(spark, tmp_path):
    d = spark.range(3).select(F.lit("j1").alias("job_id"), F.struct("id").alias("doc"))
    sinks.write_frames(d, str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f")).where("job_id = 'j1'").count() == 3


def test_frame_limits(cloud):
    p = cloud([(1, 1, 1, 0), (float("inf"), 1, 1, 0)])
    assert [r.finding for r in checks.frame_findings(p).collect()] == ["non-finite values"]
    bad = p.withColumn("conf", F.lit(1.1))
    assert checks.grid_input_findings(bad, ["point_id"]).count() == 2
