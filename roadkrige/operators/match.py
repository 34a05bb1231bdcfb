"""Map matching of count points to roads: radius, fuzzy name, nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, partial_ratio
from .spatial import within_join

RADIUS_M = 50.0
LEAST_SCORE = 60.0


def match_points(points: DataFrame, roads: DataFrame, point_id: str, road_id: str = "road_id", name: str = "road_name", road_name: str = "name",
                 radius: float = RADIUS_M, least: float = LEAST_SCORE) -> DataFrame:
    """Per point the nearest road within ``radius`` whose name scores ``least`` or more.

    Names are scored once per distinct pair of a batch, only for pairs within
    the radius.  Null names match nothing.  Ties go to the smallest road id.
    """
    left = roads.select(road_id, "pts", clean_text(F.col(road_name)).alias("_road_name"))
    right = points.select(point_id, "x", "y", clean_text(F.col(name)).alias("_name"))
    near = within_join(left, right, radius).filter("_road_name is not null and _name is not null")
    scored = near.withColumn("score", partial_ratio(F.col("_name"), F.col("_road_name"))).filter(F.col("score") >= least)
    best = scored.groupBy(point_id).agg(F.min(F.struct("d2", road_id, "score")).alias("best"))
    return best.select(point_id, F.col(f"best.{road_id}").alias(road_id), F.sqrt("best.d2").alias("distance_m"), F.col("best.score").alias("score"))
