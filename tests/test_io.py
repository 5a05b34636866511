"""Sources and sinks on small folders."""

import json

from pyspark.sql import functions as F

from strandline.sources import readers, sinks


def test_folder_tree(spark, tmp_path):
    for grp, name, side in (("control", "cell1", {"um_per_px": 0.65}), ("control", "cell2", None), ("treated", "cell3", {"name": "x", "time_interval_min": 5.0})):
        (tmp_path / grp).mkdir(exist_ok=True)
        (tmp_path / grp / f"{name}.tif").write_bytes(b"0")
        if side is not None:
            (tmp_path / grp / f"{name}.json").write_text(json.dumps(side))
    files = readers.scan_recordings(spark, str(tmp_path))
    assert sorted((r["grp"], r["name"]) for r in files.collect()) == [("control", "cell1"), ("control", "cell2"), ("treated", "cell3")]
    built = {r["name"]: (r["um_per_px"], r["time_interval_min"]) for r in readers.build_recordings(files, readers.read_sidecars(spark, str(tmp_path))).collect()}
    assert built == {"cell1": (0.65, 1.0), "cell2": (1.0, 1.0), "x": (1.0, 5.0)}


def test_detection_checkpoint(spark, tmp_path):
    m = spark.createDataFrame([("a", 0, 1, 2, 3)], "recording_id string, frame int, label int, row_ int, col_ int")
    sinks.save_detection(m, f"{tmp_path}/d")
    row = readers.load_detection(spark, f"{tmp_path}/d").first()
    assert (row["version"], row["kind"], row["provenance"], row["recording_id"]) == (2, "detection", "primary", "a")


def test_summaries_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("g", "r1", 1.0), ("g", "r2", None), ("h", "r3", 4.0)], "grp string, name string, speed double")
    sinks.group_summary_csv(rows, "grp", ["speed"], f"{tmp_path}/s")
    got = {r["grp"]: (r["n"], r["speed_mean"], r["speed_std"]) for r in spark.read.csv(f"{tmp_path}/s/groups", header=True, inferSchema=True).collect()}
    assert got["g"] == (2, 1.0, 0.0) and got["h"] == (1, 4.0, 0.0)
    assert spark.read.csv(f"{tmp_path}/s/recordings", header=True).count() == 3
    docs = sinks.metrics_documents(rows, ["name"], {"motion": ["speed"]})
    assert json.loads(docs.where("name = 'r1'").first()["document"]) == {"grp": "g", "name": "r1", "motion": {"speed": 1.0}}
    sinks.batch_summary_csv(rows.withColumnRenamed("grp", "group"), f"{tmp_path}/b")
    assert spark.read.csv(f"{tmp_path}/b", header=True).columns == sinks.SCALAR_COLUMNS


def test_params_and_names(spark):
    p = readers.params_record(spark.createDataFrame([('{"min_area_px": 7}',), ("{}",), (None,)], "params string")).select("record.*").collect()
    assert [r["min_area_px"] for r in p] == [7, 200, 200] and p[0]["n_sectors"] == 72
    f = spark.createDataFrame([("/x/frame_0001.png",), ("/x/frame_0001_masks.png",), ("/x/t2_c0003_masks9.png",), ("/x/none.png",)], "path string")
    assert {r["path"]: r["frame"] for r in readers.index_mask_files(f).collect()} == {"/x/frame_0001.png": 1, "/x/frame_0001_masks.png": 1, "/x/t2_c0003_masks9.png": 3}
    assert [tuple(r) for r in readers.pair_training_files(f.limit(2)).collect()] == [("/x/frame_0001.png", "/x/frame_0001_masks.png")]
    log = spark.createDataFrame([("k", "m")], "kind string, message string").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert sinks.log_markdown(log).first()["line"] == "- **1970-01-01 00:00:00** m"
