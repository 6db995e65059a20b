"""Observations as a stream against a static catalogue: a stream-static join, no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.operators import block


def link_stream(stream: DataFrame, catalogue: DataFrame, hub: int = 50) -> DataFrame:
    """q, s1, bit of equal exact keys.  stream and catalogue: entity_id, src, country, business_name, business_address."""
    norm = lambda d: d.withColumns({"nm": T.name_tokens(F.col("business_name")), "ad": T.addr_tokens(F.col("business_address"))})
    mine = block.catalogue_keys(block.exact_keys(norm(catalogue)), hub).select("country", "bit", "key", F.col("entity_id").alias("s1"))
    q = block.exact_keys(norm(stream)).select("country", "bit", "key", F.col("entity_id").alias("q"))
    return q.join(mine, ["country", "bit", "key"]).select("q", "s1", "bit")


def write_links(links: DataFrame, path: str, checkpoint: str):
    """Run what has arrived and stop; a later call goes on from the checkpoint."""
    query = links.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
