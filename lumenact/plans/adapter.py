"""The expression model over tables of another business: who plays genes, samples, signatures and labels.

Every frame has the engine's own columns, so the operators know nothing about where they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_GENES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gene_name(column: str):
    return F.concat(F.lit("G"), F.lpad((F.col(column) % N_GENES).cast("string"), 3, "0"))


def sample_name(column: str):
    return F.concat(F.lit("S"), F.lpad(F.col(column).cast("string"), 5, "0"))


def expression(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    """``gene, sample, value``: counts, with absent pairs standing for 0."""
    lines = table(spark, sf_dir, "lineitem")
    if flag:
        lines = lines.where(F.col("l_returnflag") == flag)
    return lines.groupBy(gene_name("l_partkey").alias("gene"), sample_name("l_suppkey").alias("sample")).agg(F.sum("l_quantity").alias("value"))


def sparse_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gene, sample, value`` with a gene a part: mostly zeros, of which no row exists."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene"), sample_name("l_suppkey").alias("sample")).agg(F.sum("l_quantity").alias("value"))


def signature(spark: SparkSession, sf_dir: str, features: int = 2) -> DataFrame:
    """``gene, feature, weight`` from the first ``features`` components of all embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    number = F.col("vec_id").cast("string")
    gene = F.concat(F.lit("G"), F.lpad(number, 3, "0"), F.substring(number, 4, 20))  # lpad cuts longer numbers
    long = rows.select(gene.alias("gene"), F.posexplode(F.slice("embedding", 1, features)).alias("pos", "w"))
    return long.select("gene", F.concat(F.lit("F"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"), F.col("w").cast("double").alias("weight"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, cell_type``: the region of a supplier."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(sample_name("s_suppkey").alias("sample"), F.col("r_name").alias("cell_type"))


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pos, gene_raw``: symbols with a version suffix and repeats, in file order."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("int").alias("pos"), F.concat(F.col("p_name"), F.lit("."), (F.col("p_partkey") % 3).cast("string")).alias("gene_raw"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, x, y``: places of the suppliers."""
    e = table(spark, sf_dir, "embeddings")
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    placed = s.join(e, F.col("vec_id") == F.col("s_suppkey"))
    return placed.select(sample_name("s_suppkey").alias("sample"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, time, event, age``: the visits of donors with usable values, one row a donor (the earliest visit)."""
    rows = table(spark, sf_dir, "clinical").where("sample is not null and time is not null and time >= 0 and event is not null")
    first = rows.groupBy("sample").agg(F.min(F.struct("visited_at", "time", "event")).alias("r"))
    return first.select("sample", F.col("r.time").alias("time"), F.col("r.event").alias("event"))


#: The same frames in SQL, to be joined with commas after WITH.
SQL = {
    "expr": """expr AS (SELECT 'G' || lpad(CAST(l_partkey % 200 AS VARCHAR), 3, '0') AS gene, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)""",
    "treated": """treated AS (SELECT 'G' || lpad(CAST(l_partkey % 200 AS VARCHAR), 3, '0') AS gene, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample,
  sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)""",
    "control": """control AS (SELECT 'G' || lpad(CAST(l_partkey % 200 AS VARCHAR), 3, '0') AS gene, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample,
  sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)""",
    "sexpr": """sexpr AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS gene, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS sample,
  sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)""",
    "sig": """sig AS (SELECT 'G' || CASE WHEN vec_id < 1000 THEN lpad(CAST(vec_id AS VARCHAR), 3, '0') ELSE CAST(vec_id AS VARCHAR) END AS gene,
  'F' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, CAST(embedding[i] AS DOUBLE) AS weight FROM embeddings, (VALUES (1), (2)) t(i))""",
    "labels": """labels AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS sample, r_name AS cell_type
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "symbols": """symbols AS (SELECT CAST(p_partkey AS INTEGER) AS pos, p_name || '.' || CAST(p_partkey % 3 AS VARCHAR) AS gene_raw FROM part)""",
    "spots": """spots AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS sample, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y
  FROM supplier JOIN embeddings ON vec_id = s_suppkey)""",
    "survival": """survival AS (SELECT sample, min({'v': visited_at, 't': time, 'e': event}) AS r FROM clinical
  WHERE sample IS NOT NULL AND time IS NOT NULL AND time >= 0 AND event IS NOT NULL GROUP BY sample)""",
    # every pair of gene and sample, with 0 where there is no row
    "dense": """genes AS (SELECT DISTINCT gene FROM expr), samples AS (SELECT DISTINCT sample FROM expr),
dense AS (SELECT g.gene, s.sample, coalesce(e.value, 0.0) AS value FROM genes g CROSS JOIN samples s LEFT JOIN expr e ON e.gene = g.gene AND e.sample = s.sample)""",
    "cpm": """cpm AS (SELECT gene, sample, log2(value / sum(value) OVER (PARTITION BY sample) * 1e6 + 1) AS value FROM dense)""",
    "diff": """diff AS (SELECT gene, sample, value - avg(value) OVER (PARTITION BY gene) AS value FROM cpm)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
