"""Imputation and scaling learned on training rows only.

Both learn one or two numbers per feature, by distributed aggregates, and apply them
as column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.ordering import exact_medians

#: Features of a pass of the scaler. Spark compiles a stage of up to 100 fields as a whole, and the three moments hold seven
#: a feature; all features in one pass are slower than a pass for each group.
SCALED_AT_ONCE = 14


@dataclass(frozen=True)
class MedianImputer:
    """Exact interpolated medians; features without any training value are dropped."""

    medians: dict[str, float]
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        gone = [f for f in self.features if f not in self.medians]
        filled = {
            f: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(m)) for f, m in self.medians.items()
        }
        return df.drop(*gone).withColumns(filled)

    @property
    def kept(self) -> list[str]:
        return [f for f in self.features if f in self.medians]


def fit_median_imputer(train: DataFrame, features: list[str]) -> MedianImputer:
    """Medians of the training rows, which are read three times: a table that took work should be written before."""
    values = train.select(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    medians = exact_medians(values, values.columns)
    return MedianImputer({f: medians[f"f{i}"] for i, f in enumerate(features) if f"f{i}" in medians}, list(features))


@dataclass(frozen=True)
class StandardScaler:
    """(x - mean) / population deviation; a constant feature is only centred."""

    moments: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                f: (F.col(f"`{f}`").cast("double") - F.lit(mean)) / F.lit(std)
                for f, (mean, std) in self.moments.items()
            }
        )


def fit_standard_scaler(train: DataFrame, features: list[str]) -> StandardScaler:
    moments = {}
    for group in batched(features, SCALED_AT_ONCE):
        sums = [F.avg(f"`{f}`").alias(f"m{i}") for i, f in enumerate(group)]
        sums += [F.stddev_pop(f"`{f}`").alias(f"s{i}") for i, f in enumerate(group)]
        sums += [(F.min(f"`{f}`") == F.max(f"`{f}`")).alias(f"c{i}") for i, f in enumerate(group)]
        row = train.agg(*sums).first()
        moments |= {f: (row[f"m{i}"], 1.0 if row[f"c{i}"] else row[f"s{i}"]) for i, f in enumerate(group)}
    return StandardScaler(moments)
