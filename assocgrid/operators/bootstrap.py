"""Bootstrap interval of a median difference without resampling rows.

The k-th smallest of n indices drawn with replacement is ceil(n * U), where U is the k-th
order statistic of n uniform numbers, a Beta(k, n - k + 1) variable.  So a resampled median
needs one Beta draw (two for even n) and the value at the drawn position of the sorted
group: exactly the distribution of resampling, at a cost that does not grow with the group.
Draws depend on the seed, the key and n alone, never on partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assocgrid.functions.finite import is_finite
from assocgrid.operators.ordered import ordered_cells

CELL = 65_536  # sorted positions per join cell


def median_positions(n: int, draws: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """1-based positions whose mean value is the median of each resample of n values."""
    k = (n + 1) // 2
    first = rng.beta(k, n - k + 1, draws)
    if n % 2:
        second = first
    else:
        second = first + (1 - first) * -np.expm1(np.log1p(-rng.random(draws)) / (n - k))
    clip = lambda u: np.clip(np.ceil(u * n), 1, n).astype("int64")
    return clip(first), clip(second)


def _draw_table(sizes: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(key, side, draw, position), two positions per draw, from one size per (key, side)."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(str(row[0]).encode()), int(row[1])])
                low, high = median_positions(int(row[2]), draws, rng)
                number = np.arange(draws)
                yield pd.DataFrame(
                    {
                        key: row[0],
                        "side": row[1],
                        "draw": np.concatenate([number, number]),
                        "position": np.concatenate([low, high]),
                    }
                )

    return sizes.mapInPandas(expand, f"`{key}` string, side int, draw int, position long")


def bootstrap_median_difference(
    df: DataFrame, key: str, value: str, low: Column, min_n: int = 3, draws: int = 1000, seed: int = 1234, levels: Sequence[float] = (0.025, 0.975)
) -> DataFrame:
    """(key, ci_low, ci_high): percentile interval of median(low) - median(other) per key."""
    rows = df.where(is_finite(value) & low.isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias(key), F.when(low, 0).otherwise(1).alias("side"), F.col(value).cast("double").alias("_v")
    )
    cells = ordered_cells(rows, [key, "side"], "_v", {"_n": "true"})
    sizes = rows.groupBy(key, "side").agg(F.count(F.lit(1)).alias("n"))
    both = sizes.groupBy(key).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("sides"))
    both = both.where((F.col("sides") == 2) & (F.col("least") >= min_n)).select(key)
    markers = _draw_table(sizes.join(both, key, "left_semi").select(key, "side", "n"), key, draws, seed)
    markers = markers.withColumn("cell", F.floor((F.col("position") - 1) / CELL))
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    spread = cells.withColumn("cell", F.explode(F.sequence(F.floor(first / CELL), F.floor(last / CELL))))
    hit = (F.col("position") > F.col("_n_before")) & (F.col("position") <= F.col("_n_before") + F.col("_n"))
    found = markers.join(spread, [key, "side", "cell"]).where(hit)
    per_draw = found.groupBy(key, "draw").agg(
        (F.avg(F.when(F.col("side") == 0, F.col("_v"))) - F.avg(F.when(F.col("side") == 1, F.col("_v")))).alias("difference")
    )
    # a group here holds exactly ``draws`` rows
    interval = F.percentile("difference", F.array(*[F.lit(q) for q in levels]))
    return per_draw.groupBy(key).agg(interval.alias("_ci")).select(key, F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"))
