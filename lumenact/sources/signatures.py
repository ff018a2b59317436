"""A catalogue of signatures by name, case-insensitive, and selections in the order asked for."""

from __future__ import annotations

import os
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_signature


class Catalogue:
    """Names and paths (or frames) of signatures."""

    def __init__(self, spark: SparkSession, entries: dict[str, str | DataFrame] | None = None):
        self.spark, self.entries = spark, {k.lower(): v for k, v in (entries or {}).items()}

    def register(self, name: str, source: str | DataFrame) -> None:
        self.entries[name.lower()] = source

    def register_folder(self, path: str) -> list[str]:
        """The tab-separated files of a folder under their names without suffix; each also becomes ``load_<name>``."""
        found = []
        for file in sorted(os.listdir(path)):
            name = file.removesuffix(".gz")
            if name.endswith((".tsv", ".txt")):
                found.append(name[:-4].lower())
                self.register(name[:-4], os.path.join(path, file))
        return found

    def __getattr__(self, name: str):
        if name.startswith("load_") and name[5:] in self.__dict__.get("entries", {}):
            return lambda **selection: self.load(name[5:], **selection)
        raise AttributeError(name)

    def names(self) -> list[str]:
        return sorted(self.entries)

    def load(self, source: str | DataFrame, features: list[str] | None = None, genes: list[str] | None = None) -> DataFrame:
        """``gene, feature, weight`` of a frame, a registered name or a path; ``features`` and ``genes`` select, and
        ``pos`` and ``feature_pos`` follow their order. Names that do not exist are warned about."""
        if isinstance(source, str):
            source = self.entries.get(source.lower(), source)
        sig = source if isinstance(source, DataFrame) else read_signature(self.spark, source)
        return select(sig, features, genes)

    def load_stratified(self, source: str | DataFrame, features: list[str] | None = None, cell_types: list[str] | None = None, cytokines: list[str] | None = None) -> DataFrame:
        """A signature of features ``cell type__cytokine`` with ``cell_type`` and ``cytokine``, filtered by either."""
        sig = self.load(source, features)
        parts = F.split("feature", "__")
        sig = sig.withColumn("cell_type", parts[0]).withColumn("cytokine", F.get(parts, F.lit(1)))
        if cell_types is not None:
            sig = sig.where(F.col("cell_type").isin(cell_types))
        if cytokines is not None:
            sig = sig.where(F.col("cytokine").isin(cytokines))
        if sig.isEmpty():
            raise ValueError("no feature matches")
        return sig

    def info(self, source: str | DataFrame) -> DataFrame:
        """One row: numbers of genes and features, and the first names of each."""
        sig = self.load(source)
        first = lambda c, n: F.slice(F.sort_array(F.collect_set(c)), 1, n)
        return sig.agg(F.countDistinct("gene").alias("n_genes"), F.countDistinct("feature").alias("n_features"), first("feature", 10).alias("features"), first("gene", 5).alias("genes"))


def select(sig: DataFrame, features: list[str] | None = None, genes: list[str] | None = None) -> DataFrame:
    spark = sig.sparkSession
    for column, wanted in (("feature", features), ("gene", genes)):
        if wanted is None:
            continue
        order = spark.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(wanted))], f"{column} string, _p int")
        lost = [r[column] for r in order.join(sig.select(column).distinct(), column, "left_anti").collect()]
        if lost:
            warnings.warn(f"{len(lost)} {column}s are not in the signature: {', '.join(sorted(lost)[:5])}", stacklevel=3)
        sig = sig.drop("pos" if column == "gene" else "feature_pos").join(F.broadcast(order), column).withColumnRenamed("_p", "pos" if column == "gene" else "feature_pos")
    return sig
