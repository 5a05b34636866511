"""The whole result of a recording: trajectory, area, overlap, boundary and edge figures in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.primitives import MINUTES, UM_PER_PX
from strandline.operators import edges, masks, pixels, quality, tracks

#: Names of the edge figures in a summary.
EDGE_NAMES = {
    "mean_protrusion_velocity": "mean_protrusion_velocity_um_min", "mean_retraction_velocity": "mean_retraction_velocity_um_min", "protrusion_fraction": "protrusion_fraction",
    "net_velocity": "net_edge_velocity_um_min", "max_protrusion": "max_protrusion_um_min", "max_retraction": "max_retraction_um_min",
}


def analyze_masks(px: DataFrame, intensity: DataFrame | None = None, um: float = UM_PER_PX, minutes: float = MINUTES, n_sectors: int = 72) -> DataFrame:
    """The summary columns of every recording of mask pixels, whose largest object of a frame is followed.

    intensity(recording_id, frame, row_, col_, intensity) adds the mean gradient on the boundary, averaged over frames; it is null
    without. Distances are in micrometres. Each part is one row per recording, and the parts meet in equi-joins on it;
    a recording that a part has no figures for keeps nulls there.
    """
    one = masks.largest_component(px)
    at = masks.centroid_series(one).select("recording_id", F.lit(0).alias("track_id"), "frame", (F.col("cy") * um).alias("cy"), (F.col("cx") * um).alias("cx"))
    out = tracks.analyze_recording(at, minutes).select(
        "recording_id", "n_frames", F.col("mean_speed").alias("mean_speed_um_min"), F.col("total_distance").alias("total_distance_um"), F.col("net_displacement").alias("net_displacement_um"), "persistence")
    area = quality.area_stability(one, um).drop("max_min_ratio")
    edge = edges.edge_summary(edges.edge_kymograph(one, n_sectors, um=um, minutes=minutes)).withColumnsRenamed(EDGE_NAMES)
    out = out.join(area, "recording_id", "left").join(edge, "recording_id", "left")
    if intensity is None:
        return out.withColumn("mean_boundary_confidence", F.lit(None).cast("double"))
    sure = pixels.boundary_confidence(intensity, one).groupBy("recording_id").agg(F.avg("confidence").alias("mean_boundary_confidence"))
    return out.join(sure, "recording_id", "left")


#: Columns of a per-cell table beside recording and frame.
CELL_COLUMNS = ["centroid_y", "centroid_x", "area_um2", "perimeter_um", "circularity", "solidity", "aspect_ratio", "eccentricity", "speed_um_min"]


def per_cell_table(px: DataFrame, um: float = UM_PER_PX, minutes: float = MINUTES) -> DataFrame:
    """recording_id, frame and CELL_COLUMNS of the largest object of every frame on the dense spine: centroid in pixels, the six descriptors, and the speed to the next frame; null where there is no object."""
    one = masks.largest_component(px)
    at = masks.centroid_series(one).select("recording_id", F.lit(0).alias("track_id"), "frame", "cy", "cx")
    speed = tracks.steps(at).select("recording_id", "frame", (F.col("step") * um / minutes).alias("speed_um_min"))
    shape = masks.shape_descriptors(one, um).drop("label")
    rows = at.withColumnsRenamed({"cy": "centroid_y", "cx": "centroid_x"}).join(shape, ["recording_id", "frame"], "left").join(speed, ["recording_id", "frame"], "left")
    return rows.select("recording_id", "frame", *CELL_COLUMNS)
