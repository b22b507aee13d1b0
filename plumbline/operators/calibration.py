"""The temperature at which score gaps predict preferences best."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a round, between the ends of the range that is left.
SECTIONS = 31


def fitted_temperature(gaps: DataFrame, gap: str = "gap", low: float = 0.05, high: float = 100.0, width: float = 1e-6) -> DataFrame:
    """One row (temperature, log_loss, n_pairs, accuracy): the least mean of ln(1 + e^(-gap / T)) over T from low to
    high; none without gaps.

    The loss is convex in 1 / T, so it has one valley in ln T. A round is one aggregate that takes the loss at many
    points at once, and leaves the two parts of the range beside the best of them, until they are `width` wide.
    """
    spark = gaps.sparkSession
    x = gaps.where(F.col(gap).isNotNull()).select(F.col(gap).cast("double").alias("g"))
    n, won = x.agg(F.count(F.lit(1)), F.avg((F.col("g") > 0).cast("int"))).first()
    if not n:
        return spark.createDataFrame([], "temperature double, log_loss double, n_pairs long, accuracy double")
    a, b = math.log(low), math.log(high)
    while True:
        points = [a + (b - a) * i / (SECTIONS + 1) for i in range(SECTIONS + 2)]
        loss = lambda t: F.avg(F.log1p(F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), F.col("g") / t)))))
        found = list(x.agg(*[loss(math.exp(p)) for p in points]).first())
        best = min(range(len(points)), key=lambda i: (round(found[i], 15), i))
        a, b = points[max(0, best - 1)], points[min(len(points) - 1, best + 1)]
        if b - a <= width:
            return spark.createDataFrame([(math.exp(points[best]), float(found[best]), n, float(won))], "temperature double, log_loss double, n_pairs long, accuracy double")
