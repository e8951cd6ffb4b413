"""Feature sets: definitions with a hash, their values in long form, and point-in-time reads of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import as_of_filter, pivot_features, unpivot_features


@dataclass(frozen=True)
class FeatureSpec:
    """A feature: its name, the columns that it reads, the rows that it looks back, and its parameters."""

    name: str
    inputs: tuple[str, ...] = ("adj_close",)
    lookback: int = 1
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FeatureSet:
    """A published version of some features; a change of definition needs a new version."""

    name: str
    version: int
    features: tuple[FeatureSpec, ...]

    def __post_init__(self) -> None:
        names = [f.name for f in self.features]
        if len(set(names)) < len(names):
            raise ValueError("a feature occurs twice")

    @property
    def max_lookback(self) -> int:
        return max((f.lookback for f in self.features), default=0)

    def spec_hash(self) -> str:
        """The same for the same definition, whatever the order of its keys."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()

    def subset(self, names: list[str]) -> FeatureSet:
        unknown = set(names) - {f.name for f in self.features}
        if unknown:
            raise KeyError(f"unknown features: {', '.join(sorted(unknown))}")
        return FeatureSet(self.name, self.version, tuple(f for f in self.features if f.name in names))

    @property
    def id(self) -> str:
        return f"{self.name}-v{self.version}"


def persist(features: FeatureSet, wide: DataFrame, path: str) -> int:
    """Appends the values that are not null to the long table at path and returns their number.

    A version that is there already must have the same definition; its values are not written twice for a symbol and ts.
    """
    spark = wide.sparkSession
    columns = [f.name for f in features.features]
    long = unpivot_features(wide, columns).where("value is not null")
    long = long.withColumn("feature_set_id", F.lit(features.id)).withColumn("spec_hash", F.lit(features.spec_hash()))
    known = stored(spark, path)
    if known is not None:
        other = known.where((F.col("feature_set_id") == features.id) & (F.col("spec_hash") != features.spec_hash()))
        if not other.isEmpty():
            raise ValueError(f"{features.id} exists with another definition: raise the version")
        long = long.join(known, ["feature_set_id", "symbol", "ts", "name"], "left_anti")
    before = 0 if known is None else known.count()
    long.select("feature_set_id", "spec_hash", "symbol", "name", "ts", "available_at", "value").write.mode("append").partitionBy("feature_set_id").parquet(path)
    return stored(spark, path).count() - before


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The long table, or None where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.parquet(path) if there else None


def load_values(long: DataFrame, feature_set_id: str | None = None, symbols: list[str] | None = None, names: list[str] | None = None, as_of=None) -> DataFrame:
    """The stored values of a set, of some symbols and names, that were knowable at as_of."""
    for column, wanted in (("feature_set_id", feature_set_id and [feature_set_id]), ("symbol", symbols), ("name", names)):
        if wanted is not None:
            long = long.where(F.col(column).isin(*wanted))
    return long if as_of is None else as_of_filter(long, as_of)


def load_matrix(long: DataFrame, names: list[str], **which) -> DataFrame:
    """symbol, ts and a column per feature."""
    return pivot_features(load_values(long, names=names, **which), names)
