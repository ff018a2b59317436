"""The queries of the eight problems over the tables of a folder, and SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bisection import cell_values, combine, from_summary, percentiles, summaries
from .bytebpe import decode, encode, token_counts
from .common import table, written
from .mixture import clusters, linked
from .packing import fill, pack
from .profiles import cell_profiles
from .similar import nearest, similar_pairs
from .splitting import split
from .topn import top_results
from .varied import sparse_points, varied_subset

#: Production parameters.
SUBSET_SIZE = 200
NEAR = 16.0
FEW = 4
CLOSE = 0.997
NEIGHBOURS = 10
PCTS = [50, 75, 90]
HIGH = 3.0
TOP = 5
CAPACITY = 4096
PIECE = 1024
OVERLAP = 64


def vocabulary_path() -> str:
    """The vocabulary file: ``LUMENACT_TOKENIZERS`` names another folder than /opt/tokenizers."""
    return os.path.join(os.environ.get("LUMENACT_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_points(cell_profiles(spark, sf_dir), NEAR, FEW, SUBSET_SIZE)


def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_subset(cell_profiles(spark, sf_dir), SUBSET_SIZE, kind=NEAR)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = percentiles(cell_values(spark, sf_dir, ["ext"]), ["annotation", "feature"], PCTS)
    return found.where(F.col("value") >= HIGH).select("annotation", "feature", "pct")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(cell_values(spark, sf_dir, ["core", "ext"]), ["annotation", "feature"], PCTS)


def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["annotation", "feature"]
    days = summaries(cell_values(spark, sf_dir, ["core", "ext"]), [*keys, "day"])
    return from_summary(combine(days, keys), keys, PCTS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chained = linked(cell_profiles(spark, sf_dir), NEAR)
    return chained.where("sample <> first").select(F.col("first").alias("sample_a"), F.col("sample").alias("sample_b"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(cell_profiles(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_results(table(spark, sf_dir, "activity"), TOP).select("sample", "feature", "run_id")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_results(table(spark, sf_dir, "activity"), TOP).select("sample", "rank_no", "feature", "run_id", "zscore", "pvalue")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(cell_profiles(spark, sf_dir, "beta"), CLOSE)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(cell_profiles(spark, sf_dir, "beta"), NEIGHBOURS)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path())


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents"), vocabulary_path()), CAPACITY)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _packed(spark, sf_dir).where("pieces > 1").groupBy("doc_id").agg(F.min("container").alias("least"), F.max("container").alias("most"))
    return places.where("least < most").select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(_packed(spark, sf_dir), CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_pieces(spark, sf_dir).where("piece = 0 and text <> ''").select("doc_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(table(spark, sf_dir, "documents"), vocabulary_path(), PIECE, OVERLAP)


# --- what results must be like, where SQL cannot give the results themselves


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chains of cells within the distance the subset has a row of: all of them, while they are fewer than its rows."""
    chained = linked(cell_profiles(spark, sf_dir), NEAR)
    return p1_subset(spark, sf_dir).select("sample").join(chained, "sample").agg(F.count_distinct("first").alias("kinds"))


def p2_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many combined percentiles there are, and how many of them are off by more than 1 % in rank."""
    keys = ["annotation", "feature"]
    v, q = cell_values(spark, sf_dir, ["core", "ext"]), p2_combined(spark, sf_dir)
    counts = v.select(*keys, "v").join(q, keys).groupBy(*keys, "pct").agg(
        F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"), F.count("*").alias("all")
    )
    rank, slack = F.greatest(F.ceil(F.col("pct") * F.col("all") / 100), F.lit(1)), 0.01 * F.col("all")
    good = (F.col("below") - slack < rank) & (rank <= F.col("upto") + slack)
    return counts.agg(F.count("*").alias("percentiles"), F.count_if(~good).alias("off"))


def p3_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of all clusters together."""
    return p3_clusters(spark, sf_dir).agg(F.sum("size").alias("cells"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of what the ids of each document decode to."""
    ids = p6_ids(spark, sf_dir)
    return ids.select("doc_id", F.md5(decode(ids, vocabulary_path())).alias("digest"))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in containers, the containers above the capacity and the documents split without need."""
    packed = written(_packed(spark, sf_dir))
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("over"))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    return whole.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= CAPACITY)).alias("split")).join(over)


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document's text, of those in pieces put together from what is new in each."""
    before = F.coalesce(F.lag("end").over(Window.partitionBy("doc_id").orderBy("piece")), F.lit(0))
    parts = p8_pieces(spark, sf_dir).withColumn("new", F.substring("text", (before - F.col("start") + 1).cast("int"), F.char_length("text")))
    order = F.array_sort(F.collect_list(F.struct("piece", "new")))
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda x: x["new"]), "").alias("_whole"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(joined, "doc_id", "left")
    return docs.select("doc_id", F.md5(F.coalesce("_whole", "text", F.lit("")).cast("binary")).alias("digest"))


_MODULE_QUERIES = [p1_found, p1_subset, p2_found, p2_percentiles, p2_combined, p3_found, p3_clusters, p4_found, p4_top, p5_found, p5_neighbours, p6_ids, p7_found, p7_containers, p7_fill, p8_found, p8_pieces, p1_kinds, p2_bound, p3_cells, p6_texts, p7_limits, p8_texts]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _MODULE_QUERIES}

from .oracles import ORACLES  # noqa: E402, F401
