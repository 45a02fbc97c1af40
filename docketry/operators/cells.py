"""What happened in a grid cell, by either of several points of a case, and in its neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import geo

#: Largest neighbourhood.
MOST_STEPS = 5


def touches(cases: DataFrame, points: list[tuple[Column, Column]], res: int, *keep: str) -> DataFrame:
    """(cell, case_id, *keep): every case once in each cell that one of its points lies in; null points and points off the
    earth lie in none. No shuffle: a case's cells are made distinct within its row."""
    cells = F.array_distinct(F.array_compact(F.array(*[geo.cell_for(lat, lng, res) for lat, lng in points])))
    return cases.select(F.explode(cells).alias("cell"), "case_id", *keep)


def cell_stats(touched: DataFrame) -> DataFrame:
    """(cell, n_cases, n_convictions, n_pleas, mean_sentence, rate) of touches() with outcome, plea_accepted and
    sentence_months; the mean is that of convictions."""
    convicted = F.col("outcome") == "conviction"
    by = touched.groupBy("cell").agg(F.count("*").alias("n_cases"), F.count_if(convicted).alias("n_convictions"), F.count_if("plea_accepted").alias("n_pleas"), F.avg(F.when(convicted, F.col("sentence_months"))).alias("mean_sentence"))
    return by.withColumn("rate", F.col("n_convictions") / F.nullif("n_cases", F.lit(0)))


def ring_stats(stats: DataFrame, k: int = 1) -> DataFrame:
    """(cell, n_cases, n_convictions, rate) over every cell and those within k steps of it, 1 to MOST_STEPS. Cells are
    counted before they meet their neighbours, so only counts are shuffled."""
    ring = stats.select("cell", F.explode(geo.k_ring(F.col("cell"), max(1, min(MOST_STEPS, k)))).alias("near"))
    seen = ring.join(stats.select(F.col("cell").alias("near"), "n_cases", "n_convictions"), "near").groupBy("cell").agg(F.sum("n_cases").alias("n_cases"), F.sum("n_convictions").alias("n_convictions"))
    return seen.withColumn("rate", F.col("n_convictions") / F.nullif("n_cases", F.lit(0)))


def backfilled(rows: DataFrame, cell: str, lat: Column, lng: Column, res: int) -> DataFrame:
    """rows with the cell column filled where it is null; a cell that is there stays."""
    return rows.withColumn(cell, F.coalesce(F.col(cell), geo.cell_for(lat, lng, res)))
