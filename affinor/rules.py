"""Field rules as data, and the engine's parameters."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Params:
    """Thresholds that must equal the published values for the results to agree (fixed values)."""
    k: int = 5
    threshold_quantile: float = 0.25
    vector_items: int = 30
    representatives: int = 3
    recent_years: int = 2
    topic_share: float = 0.40
    affiliation_years: int = 3
    split_ratio: float = 0.10
    anchor_similarity: int = 90
    flag_cosine: float = 0.70
    outlier_cut: float = 0.6375
    suspect_share: float = 0.3
    min_screen_items: int = 3
    certain_margin: float = 0.8
    fdr: float = 0.2
    permutations: int = 10000
    min_period_items: int = 4
    outlier_mads: float = 2.5
    outlier_floor: float = 0.72
    soft_map_k: int = 8
    soft_map_sharpness: float = 40.0
    near_entities: int = 20
    toward_entities: int = 5
    near_groups: int = 3
    subcluster_min_size: int = 20
    subcluster_min_part: int = 4
    subcluster_per_part: int = 10


PARAMS = Params()

# (label, lowest size, highest size) for the audit tables (fixed values)
SIZE_BINS = (("5 or fewer", 0, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21 or more", 21, 9223372036854775807))

RULE_SCHEMA = ("field long, min_items int, position_agnostic boolean, alphabetical_counts boolean, "
               "max_authors int, types array<string>")


def rules_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rule dimension: one row per field, a few rows in total."""
    return spark.createDataFrame(rows, RULE_SCHEMA)
