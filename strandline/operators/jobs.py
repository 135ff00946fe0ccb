"""Prediction jobs as JSON, key-value stores, and chains put side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A job: entities are a union of kinds, of which one field is set.
JOB = """struct<name: string, modelSeeds: array<bigint>, sequences: array<struct<
  proteinChain: struct<sequence: string, count: int, pairedMsaPath: string, unpairedMsaPath: string, msa: struct<precomputed_msa_dir: string, pairing_db: string>>,
  dnaSequence: struct<sequence: string, count: int>, rnaSequence: struct<sequence: string, count: int, unpairedMsaPath: string>,
  ligand: struct<ligand: string, count: int>, ion: struct<ion: string, count: int>>>,
  covalent_bonds: array<struct<entity1: string, copy1: int, position1: string, atom1: string, entity2: string, copy2: int, position2: string, atom2: string>>>"""
KINDS = {"proteinChain": "sequence", "dnaSequence": "sequence", "rnaSequence": "sequence", "ligand": "ligand", "ion": "ion"}
POLYMERS = {"proteinChain": "polypeptide(L)", "dnaSequence": "polydeoxyribonucleotide", "rnaSequence": "polyribonucleotide"}


def parse_jobs(texts: DataFrame, col: str = "value") -> DataFrame:
    """job_no (of the text's list), job; malformed text gives no job."""
    return texts.select(F.posexplode(F.from_json(F.col(col), f"array<{JOB}>")).alias("job_no", "job"))


def entities(jobs: DataFrame) -> DataFrame:
    """name, entity (from 1), kind, value (sequence or code), n (copies, 1 by default), poly_type."""
    rows = jobs.select("job.name", F.posexplode("job.sequences").alias("_p", "e"))
    kind = F.coalesce(*[F.when(F.col(f"e.{k}").isNotNull(), k) for k in KINDS])
    value = F.coalesce(*[F.col(f"e.{k}.{v}") for k, v in KINDS.items()])
    n = F.coalesce(*[F.col(f"e.{k}.count") for k in KINDS], F.lit(1))
    poly = F.coalesce(*[F.when(F.col(f"e.{k}").isNotNull(), t) for k, t in POLYMERS.items()])
    return rows.select("name", (F.col("_p") + 1).alias("entity"), kind.alias("kind"), value.alias("value"), n.alias("n"), poly.alias("poly_type"), "e")


def needs_search(jobs: DataFrame) -> DataFrame:
    """name and whether any protein has neither of its alignments."""
    missing = F.exists("job.sequences", lambda s: s["proteinChain"].isNotNull() & s["proteinChain"]["pairedMsaPath"].isNull() & s["proteinChain"]["unpairedMsaPath"].isNull())
    return jobs.select("job.name", F.coalesce(missing, F.lit(False)).alias("needs_search"))


def modernised(jobs: DataFrame) -> DataFrame:
    """Jobs whose old msa objects have become paths of the paired and unpaired alignment."""

    def one(s: Column) -> Column:
        old, p = s["proteinChain"]["msa"]["precomputed_msa_dir"], s["proteinChain"]
        chain = p.withField("pairedMsaPath", F.coalesce(p["pairedMsaPath"], F.concat(old, F.lit("/pairing.a3m")))).withField("unpairedMsaPath", F.coalesce(p["unpairedMsaPath"], F.concat(old, F.lit("/non_pairing.a3m"))))
        return F.when(p.isNull(), s).otherwise(s.withField("proteinChain", chain.dropFields("msa").withField("msa", p["msa"])))

    return jobs.withColumn("job", F.col("job").withField("sequences", F.transform("job.sequences", one)))


def kv_store(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """A store of values under the SHA-1 of their keys; of repeated keys the largest value stays."""
    return pairs.groupBy(F.sha1(F.col(key).cast("string")).alias("key_hash")).agg(F.max(value).alias("value"))


def kv_lookup(rows: DataFrame, store: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the value of their key, null where the store has none."""
    return rows.withColumn("key_hash", F.sha1(F.col(key).cast("string"))).join(store.withColumnRenamed("value", name), "key_hash", "left").drop("key_hash")


def standard_positions(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """Position of each token (asym, res from 1) in the concatenated sequences: offset of its chain, else of the chain before it, else -1."""
    own = offsets.select(F.col("asym"), F.col("offset").alias("_own"), F.col("length").alias("_n"))
    prior = offsets.select((F.col("asym") + 1).alias("asym"), F.col("offset").alias("_prior"), F.col("length").alias("_pn"))
    rows = tokens.join(own, "asym", "left").join(prior, "asym", "left")
    inside = lambda n: F.col("res").between(1, F.col(n))
    at = F.coalesce(F.when(inside("_n"), F.col("_own") + F.col("res") - 1), F.when(F.col("_own").isNull() & inside("_pn"), F.col("_prior") + F.col("res") - 1), F.lit(-1))
    return rows.withColumn("position", at).drop("_own", "_n", "_prior", "_pn")


def side_by_side(chains: list[DataFrame], widths: list[int], gap: int = 31) -> DataFrame:
    """Rows (row, codes) of several chains joined by row number into one array; a chain without the row is all gaps."""
    out = None
    for i, (df, w) in enumerate(zip(chains, widths)):
        part = df.select("row", F.col("codes").alias(f"c{i}"))
        out = part if out is None else out.join(part, "row", "full")
    filled = [F.coalesce(F.col(f"c{i}"), F.array_repeat(F.lit(gap), w)) for i, w in enumerate(widths)]
    return out.select("row", F.concat(*filled).alias("codes"))


def split_rows(msa: DataFrame, lengths: list[int]) -> DataFrame:
    """Rows of a joint alignment cut into chains of the given numbers of aligned columns; insertions go with the column after them.

    row, chain (from 0), seq, is_dummy (gaps only).
    """
    # One piece for each aligned column: the insertions before it and itself; what follows the last goes with it.
    pieces = F.regexp_extract_all("seq", F.lit("[a-z]*[^a-z](?:[a-z]+$)?"), F.lit(0))
    starts = [sum(lengths[:i]) for i in range(len(lengths))]
    parts = F.array(*[F.struct(F.lit(i).alias("chain"), F.array_join(F.slice(pieces, s + 1, n), "").alias("seq")) for i, (s, n) in enumerate(zip(starts, lengths))])
    rows = msa.select("row", F.explode(parts).alias("p")).select("row", "p.chain", "p.seq")
    return rows.withColumn("is_dummy", F.regexp_replace("seq", "[-a-z]", "") == "")


def drop_uneven_bonds(bonds: DataFrame, chains: DataFrame) -> DataFrame:
    """Bonds between entities without those sites whose number of bonded copies is not the smaller number of copies.

    bonds: entity1, chain1, res1, atom1, entity2, chain2, res2, atom2; chains: entity, chain.
    """
    site = ["entity1", "res1", "atom1", "entity2", "res2", "atom2"]
    copies = chains.groupBy("entity").agg(F.countDistinct("chain").alias("n"))
    counts = bonds.groupBy(*site).agg(F.countDistinct("chain1").alias("_b1"), F.countDistinct("chain2").alias("_b2"))
    one, two = (copies.select(F.col("entity").alias(f"entity{k}"), F.col("n").alias(f"_n{k}")) for k in (1, 2))
    good = counts.join(one, "entity1").join(two, "entity2").where("_b1 = least(_n1, _n2) AND _b2 = least(_n1, _n2)").select(*site)
    return bonds.join(good, site, "left_semi")


def stockholm(name: Callable[[Column], Column] = lambda r: r.cast("string")) -> Callable[[DataFrame], DataFrame]:
    """A function from rows (query, row, seq) to Stockholm rows of equal width (query, row, name, seq).

    A column opens before every aligned column for the longest insertion that any row has there.
    """

    def convert(msa: DataFrame) -> DataFrame:
        runs = F.concat(F.regexp_extract_all("seq", F.lit("([a-z]*)[^a-z]"), F.lit(1)), F.array(F.regexp_extract("seq", "([a-z]*)$", 1)))
        columns = F.concat(F.regexp_extract_all("seq", F.lit("[^a-z]"), F.lit(0)), F.array(F.lit("")))
        rows = msa.select("query", "row", runs.alias("runs"), columns.alias("columns"))
        widths = rows.select("query", F.posexplode("runs").alias("at", "r")).groupBy("query", "at").agg(F.max(F.length("r")).alias("w"))
        widths = widths.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("widths"))
        both = rows.join(widths, "query")
        seq = F.transform("columns", lambda c, i: F.concat(F.rpad(F.upper(F.get("runs", i)), F.get("widths", i), "-"), c))
        return both.select("query", "row", name(F.col("row")).alias("name"), F.array_join(seq, "").alias("seq"))

    return convert


def a3m_of_stockholm(lines: DataFrame, most: int | None = None) -> DataFrame:
    """query, row, name, seq from Stockholm lines (query, pos, line): blocks are joined, columns where the first row has a gap become insertions."""
    from pyspark.sql import Window as W

    from strandline.functions import sequences as S

    parts = lines.where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '//')")
    parts = parts.select("query", "pos", F.regexp_extract("line", r"^(\S+)", 1).alias("name"), F.replace(F.regexp_extract("line", r"^\S+\s+(\S+)", 1), F.lit("."), F.lit("-")).alias("part"))
    rows = parts.groupBy("query", "name").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"))
    rows = rows.select("query", "name", "first", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("aligned"))
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("query").orderBy("first")) - 1)
    if most is not None:
        rows = rows.where(F.col("row") < most)
    head = rows.where("row = 0").select("query", F.col("aligned").alias("head"))
    return rows.join(head, "query").select("query", "row", "name", S.align_to_query(F.col("aligned"), F.col("head")).alias("seq"))
