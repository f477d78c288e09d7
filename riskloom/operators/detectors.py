"""Results of detectors from outside, brought to the ensemble's three kinds; samples of a feature as a median and a peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in a detector's name that tell its kind, the first kind that fits; and confidences before any result.
KINDS = {"ml": ("pipeline", "model", "random_forest", "isolation_forest", "advanced"), "z": ("zscore", "z_score"), "auth": ("auth",)}
LEAST = {"ml": 0.75, "z": 0.0, "auth": 0.0}
#: The confidence of a result that names none, the samples that a baseline takes.
CONFIDENCE, SAMPLES = 0.70, 128


def kind(name: Column) -> Column:
    """ml, z or auth by the words in ``name``; null for other detectors."""
    words = [(k, F.lower(name).rlike("|".join(w))) for k, w in KINDS.items()]
    out = F.lit(None).cast("string")
    for k, fits in reversed(words):
        out = F.when(fits, k).otherwise(out)
    return out


def external(results: DataFrame, key: str) -> DataFrame:
    """One row a ``key``: the greatest score and confidence of each kind, and how many results were anomalies.

    ``results``: detector_name, score, confidence, is_anomaly, is_shadow. Shadow results count nowhere; those of no
    kind count as anomalies only. Null scores are 0, null flags false. A key with shadow results alone has its
    row, at the least confidences. All are partial aggregates, so a key with many results is combined before the shuffle.
    """
    active = ~F.coalesce("is_shadow", F.lit(False))
    k = kind(F.col("detector_name"))
    greatest = lambda c, of, least: F.greatest(F.coalesce(F.max(F.when(active & (k == of), c)), F.lit(least)), F.lit(least))
    score, confidence = F.coalesce("score", F.lit(0.0)), F.coalesce("confidence", F.lit(CONFIDENCE))
    columns = [greatest(score, of, 0.0).alias(f"{of}_score") for of in KINDS] + [greatest(confidence, of, LEAST[of]).alias(f"{of}_confidence") for of in KINDS]
    return results.groupBy(key).agg(*columns, F.count_if(active & F.coalesce("is_anomaly", F.lit(False))).alias("anomalies"))


def extremes(samples: DataFrame, keys: list[str], order: list[Column], value: str, most: int = SAMPLES) -> DataFrame:
    """Of each key: the median of its first ``most`` values by ``order`` and how many these are, and the peak of all its values.

    Values below zero count as zero, nulls don't count, keys without values have no row. Peaks are combined before
    their shuffle, and a key's rows are cut to its first ones before theirs, so a hot key stays small in either.
    """
    known = samples.where(F.col(value).isNotNull()).withColumn(value, F.greatest(value, F.lit(0.0)))
    first = known.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= most)
    medians = first.groupBy(*keys).agg(F.count("*").alias("samples"), F.percentile(value, 0.5).alias("median"))
    return medians.join(known.groupBy(*keys).agg(F.max(value).alias("peak")), keys)
