"""Views of the driver's tables that stand for the engine's own tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOLS = ("prot", "nuc", "ligand")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mol(key: str):
    k = F.col(key) % 3
    return F.when(k == 0, MOLS[0]).when(k == 1, MOLS[1]).otherwise(MOLS[2])


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain and interface index: one row per line item, all keys as strings."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    even = F.col("l_linenumber") % 2 == 0
    return items.join(brands, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("pdb_id"),
        F.when(even, "interface").otherwise("chain").alias("type"),
        F.col("l_partkey").cast("string").alias("entity_1_id"),
        F.when(even, F.col("l_suppkey").cast("string")).alias("entity_2_id"),
        F.col("p_brand").alias("cluster_id"),
        _mol("l_partkey").alias("mol_1_type"),
        F.when(even, _mol("l_suppkey")).alias("mol_2_type"),
        F.col("l_quantity").cast("int").alias("num_tokens"),
        F.to_date("l_shipdate").alias("release_date"),
        F.col("l_linenumber").cast("long").alias("row_no"),
    )


INDEX = """
v_index AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS pdb_id, CASE WHEN l_linenumber % 2 = 0 THEN 'interface' ELSE 'chain' END AS type,
         CAST(l_partkey AS VARCHAR) AS entity_1_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS entity_2_id,
         p_brand AS cluster_id, CASE l_partkey % 3 WHEN 0 THEN 'prot' WHEN 1 THEN 'nuc' ELSE 'ligand' END AS mol_1_type,
         CASE WHEN l_linenumber % 2 = 0 THEN CASE l_suppkey % 3 WHEN 0 THEN 'prot' WHEN 1 THEN 'nuc' ELSE 'ligand' END END AS mol_2_type,
         CAST(l_quantity AS INT) AS num_tokens, CAST(l_shipdate AS DATE) AS release_date, CAST(l_linenumber AS BIGINT) AS row_no
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of ten structures: coordinates, chain, residue, entity, and a predicted position."""
    e = F.col("embedding")
    coordinate = lambda i: e[i].cast("double") * 25
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("pdb_id"),
        F.col("vec_id").alias("atom_idx"),
        coordinate(0).alias("x"),
        coordinate(1).alias("y"),
        coordinate(2).alias("z"),
        (coordinate(0) + e[3].cast("double") * 5).alias("px"),
        (coordinate(1) + e[4].cast("double") * 5).alias("py"),
        (coordinate(2) + e[5].cast("double") * 5).alias("pz"),
        (F.col("vec_id") % 4).alias("chain_id"),
        F.floor(F.col("vec_id") / 5).alias("res_id"),
        (F.col("vec_id") % 4 % 2).alias("entity_id"),
        (F.col("vec_id") % 7 != 0).alias("is_resolved"),
        F.element_at(F.array(*[F.lit(n) for n in ("ALA", "GLY", "UNK", "N", "HOH")]), (F.floor(F.col("vec_id") / 5) % 5 + 1).cast("int")).alias("res_name"),
        F.element_at(F.array(*[F.lit(n) for n in ("N", "CA", "C", "O", "CB")]), (F.col("vec_id") % 5 + 1).cast("int")).alias("atom_name"),
    )


ATOMS = """
v_atoms AS (
  SELECT label AS pdb_id, vec_id AS atom_idx,
         CAST(embedding[1] AS DOUBLE) * 25 AS x, CAST(embedding[2] AS DOUBLE) * 25 AS y, CAST(embedding[3] AS DOUBLE) * 25 AS z,
         CAST(embedding[1] AS DOUBLE) * 25 + CAST(embedding[4] AS DOUBLE) * 5 AS px,
         CAST(embedding[2] AS DOUBLE) * 25 + CAST(embedding[5] AS DOUBLE) * 5 AS py,
         CAST(embedding[3] AS DOUBLE) * 25 + CAST(embedding[6] AS DOUBLE) * 5 AS pz,
         vec_id % 4 AS chain_id, vec_id // 5 AS res_id, vec_id % 4 % 2 AS entity_id, vec_id % 7 <> 0 AS is_resolved,
         (['ALA', 'GLY', 'UNK', 'N', 'HOH'])[vec_id // 5 % 5 + 1] AS res_name, (['N', 'CA', 'C', 'O', 'CB'])[vec_id % 5 + 1] AS atom_name
  FROM embeddings)"""

#: Pairs of atoms of one structure, each once.
PAIRS = (
    ATOMS
    + """,
v_pairs AS (
  SELECT a.pdb_id, a.atom_idx AS i, b.atom_idx AS j, a.chain_id AS ci, b.chain_id AS cj, a.entity_id AS ei, b.entity_id AS ej, a.res_id AS ri, b.res_id AS rj,
         a.is_resolved AND b.is_resolved AS both_resolved,
         sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2) AS pd
  FROM v_atoms a JOIN v_atoms b ON a.pdb_id = b.pdb_id AND a.atom_idx < b.atom_idx)"""
)


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment rows: query, row, species, and a sequence whose lower-case letters are insertions."""
    letters = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("query"), F.col("doc_id").alias("row"), F.col("source").alias("species"), F.translate(letters, "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ").alias("seq")
    )


MSA = """
v_msa AS (
  SELECT lang AS query, doc_id AS row, source AS species,
         translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), 'bcdfghjklmnpqrstvwxyz', 'BCDFGHJKLMNPQRSTVWXYZ') AS seq
  FROM documents)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template hits: query, hit, score, release date, aligned columns and a hit sequence."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("query"),
        F.col("o_orderkey").alias("hit"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("sum_probs"),
        F.to_date("o_orderdate").alias("release_date"),
        (F.col("o_orderkey") % 100).alias("aligned_cols"),
        (F.col("o_custkey") % 500).cast("string").alias("hit_sequence"),
    )


HITS = """
v_hits AS (
  SELECT c_mktsegment AS query, o_orderkey AS hit, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS sum_probs, CAST(o_orderdate AS DATE) AS release_date,
         o_orderkey % 100 AS aligned_cols, CAST(o_custkey % 500 AS VARCHAR) AS hit_sequence
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of samples: sample, seed, metric, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("seed"), F.col("event_type").alias("metric"), "value")


SCORES = "\nv_scores AS (SELECT user_id AS sample, event_id AS seed, event_type AS metric, value FROM events)"


def tax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit names with taxa; the last of repeated names wins."""
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("hit"), F.col("n_nationkey").alias("taxid")
    )


TAX = "\nv_m8 AS (SELECT s_suppkey AS pos, s_name AS hit, n_nationkey AS taxid FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
