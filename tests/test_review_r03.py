"""Findings of the third review. The tests are meant to fail on the code before (the one of the view to hold on both); they were not run on it."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from strandline.functions import primitives
from strandline.operators import linking, masks, objects
from strandline.plans import fixtures, q_tables
from strandline.plans.q_tracks import rounded


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sum_fixes_its_cuts(spark):
    rows = spark.range(0, 5000, 1, 16).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 5003).cast("double").alias("x"), F.lit(1).alias("one"))
    out = primitives.running_sum(rows, ["g"], "x", "one", "below")
    assert "percentile_approx" not in plan(out)
    got = out.toPandas()
    want = got.groupby("g")["x"].rank(method="first") - 1
    assert (got["below"] == want).all()


def test_rounded_scales_as_the_sql_does(spark):
    duck = duckdb.connect()
    values = np.random.default_rng(3).integers(0, 10**6, 4000) / 10**6 + 0.000005
    got = [r["x"] for r in rounded(spark.createDataFrame([(float(v),) for v in values], "x double"), "x", n=5).collect()]
    assert got == [duck.execute("select round(?::double, 5)", [float(v)]).fetchone()[0] for v in values]


def test_one_row_for_files_that_share_a_stem(spark):
    files = spark.createDataFrame([("/exp/a/cell_1234.tif",)] * 3 + [("/exp/a/cell_1234.mp4",)], "path string")
    rec = spark.createDataFrame([(1234, "n", 0.5, 2.0)], "recording_id long, name string, um_per_px double, time_interval_min double")
    from strandline.sources import readers as R

    scanned = R.recordings_of(files)
    assert q_tables.with_sidecars(scanned, rec).count() == 4


def test_mask_view_equals_its_sql(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    want, got = spark.sql(fixtures.SPARK["mask_px"]), fixtures.view(spark, sf_dir, "mask_px")
    assert dict(got.dtypes) == dict(want.dtypes)
    assert got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty()


def test_edge_pixels_stay_with_their_frame(spark, sf_dir):
    px = fixtures.view(spark, sf_dir, "mask_px")
    shuffles = lambda df: plan(df).count("Exchange hashpartitioning")
    # The holes, small arrays, are dealt once more.
    assert shuffles(px) == 2 and shuffles(masks.boundary_pixels(px)) <= 2 * shuffles(px) + 1
    assert shuffles(masks.boundary_pixels(masks.largest_component(px))) <= 4 * shuffles(px) + 1
    assert "BroadcastHashJoin" not in plan(masks.best_overlap_component(px, px.where("label = 2")))


def test_components_across_bands(spark):
    snake = [(r, c) for r in range(40) for c in ([r % 3] if r % 7 else range(5))] + [(r, 9) for r in range(40)]
    px = spark.createDataFrame([("a", 0, 1, r, c) for r, c in snake], "recording_id string, frame int, label int, row_ int, col_ int")
    key = lambda df: sorted(map(tuple, df.select("label", "row_", "c0", "c1").collect()))
    assert key(masks.component_runs(px, band=4)) == key(masks.component_runs(px))
    assert masks.component_runs(px, band=4).where("c0 = 9").select("label").distinct().count() == 1


def test_objects_share_a_batch(spark):
    px = spark.createDataFrame([("a", f, k, r, c) for f in range(40) for k in (1, 2) for r in range(2) for c in range(k)], "recording_id string, frame int, label int, row_ int, col_ int")
    out = objects.per_object_apply(px, lambda crop: crop, 1)
    assert "InPandas" not in plan(out) and out.exceptAll(px).isEmpty() and out.count() == px.count()


def test_exploded_sides_are_not_broadcast(spark):
    det = spark.createDataFrame([("a", 0, 1, 0.0, 0.0, 5), ("a", 1, 1, 3.0, 4.0, 5)], "recording_id string, frame int, label int, cy double, cx double, area_px int")
    found = linking.link_candidates(det)
    assert "BroadcastHashJoin" not in plan(found) and [r["dist"] for r in found.collect()] == [5.0]
