"""From records to a result row for every catalogue entry, by the whole flow with a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmatch.plans import flow
from kinmatch.plans.queries import View


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source1_entity_id, matched_entity_ids."""
    return flow.run(View(spark, sf_dir)).results
