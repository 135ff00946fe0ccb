"""PDB text to chains, entities and mmCIF tables: what the text does not say is inferred from names and numbers.

Windows are over one structure, chain or residue, whose size the format bounds (five columns for the serial number, four
for the residue's). To infer entities no more than these windows is needed, so lines that `by_file` has dealt are not shuffled again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.sequences import letters_of_number

# Residues that count as protein, DNA and RNA, and the name of a residue that is missing.
PROTEIN = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "UNK")
DNA = ("DA", "DG", "DC", "DT", "DN")
RNA = ("A", "G", "C", "U", "N")
MISSING = {"dna": "DN", "rna": "N", "protein": "UNK"}

#: Lines of a part of `by_file`.
LINES = 200_000

#: Categories of the text that `cif_tables` gives, with their columns.
CATEGORIES = {
    "entity": ["id", "type"],
    "entity_poly": ["entity_id", "type"],
    "entity_poly_seq": ["entity_id", "num", "mon_id"],
    "struct_asym": ["id", "entity_id"],
    "atom_site": [
        "group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z",
        "occupancy", "B_iso_or_equiv", "auth_seq_id", "auth_comp_id", "auth_asym_id", "pdbx_PDB_model_num",
    ],
}


def by_file(rows: DataFrame, lines: int, key: str = "pdb_id") -> DataFrame:
    """rows dealt by file to parts of about LINES of all the lines, so what a task holds does not grow with the number of files.

    Adaptive execution would size parts by compressed bytes, and PDB text shrinks to a small part of what its rows take in memory.
    """
    return rows.repartition(max(1, math.ceil(lines / LINES)), key)


def _file():
    return W.partitionBy("pdb_id").orderBy("pos")


def _changes(*columns: str) -> Column:
    """Running number of the runs in which all the columns stay the same."""
    same = F.lag(F.struct(*columns)).over(_file()).eqNullSafe(F.struct(*columns))
    return F.sum((~same).cast("int")).over(_file())


def first_model(lines: DataFrame) -> DataFrame:
    """Atoms of the first model, of each residue those without a place indicator or with the first one named.

    lines: pdb_id, pos (order in the file), line. Null lines and other records are passed over. An atom without an element
    takes the first letter of its name. Adds chain_run and residue, running numbers from 1.
    """
    at = lambda start, n: F.trim(F.substring("line", start, n))
    record = F.substring("line", 1, 6)
    letter = F.regexp_extract(at(13, 4), "[A-Za-z]", 0)
    number = lambda start, n, to: F.when(record != "MODEL ", at(start, n)).try_cast(to)  # noqa: E731  a failed cast is slow, and MODEL has no such columns
    # Lines are cut before they are sorted, so only the columns that are asked for reach the windows.
    rows = lines.where(record.isin("ATOM  ", "HETATM", "MODEL ")).select(
        "pdb_id", "pos", (record == "MODEL ").alias("_model"), (record == "HETATM").alias("hetero"), at(13, 4).alias("atom_name"), at(17, 1).alias("alt"), at(18, 3).alias("res_name"), at(22, 1).alias("chain_id"), number(23, 4, "int").alias("res_id"), at(27, 1).alias("ins"),
        *[number(31 + 8 * k, 8, "double").alias(c) for k, c in enumerate("xyz")], F.coalesce(number(55, 6, "double"), F.lit(1.0)).alias("occupancy"), F.coalesce(number(61, 6, "double"), F.lit(0.0)).alias("b"),
        F.coalesce(F.nullif(at(77, 2), F.lit("")), letter).alias("element"),
    )
    atoms = rows.withColumn("_m", F.sum(F.col("_model").cast("int")).over(_file())).where("_m <= 1 AND NOT _model").drop("_m", "_model")
    atoms = atoms.withColumn("chain_run", _changes("chain_id")).withColumn("residue", _changes("chain_id", "res_id", "ins", "res_name"))
    named = F.min(F.when(F.col("alt") != "", F.struct("pos", "alt"))).over(W.partitionBy("pdb_id", "residue"))["alt"]
    return atoms.withColumn("_alt", named).where((F.col("alt") == "") | (F.col("alt") == F.col("_alt"))).drop("_alt")


def segments(atoms: DataFrame) -> DataFrame:
    """Adds segment, from 1: a new one where the chain or the kind of record changes, and at each HETATM residue of a higher number."""
    before = lambda c: F.lag(c).over(_file())
    stays = before("chain_run").eqNullSafe(F.col("chain_run")) & before("hetero").eqNullSafe(F.col("hetero"))
    next_het = F.coalesce(F.col("hetero") & (F.col("res_id") - before("res_id") >= 1), F.lit(False))
    return atoms.withColumn("_new", (~stays | next_het).cast("int")).withColumn("segment", F.sum("_new").over(_file())).drop("_new")


def filled_residues(atoms: DataFrame) -> DataFrame:
    """pdb_id, segment, num (from 1), residue (null where it is missing), res_name.

    Chains without HETATM get a residue for each number that their sequence skips, named by what most of their distinct names are.
    """
    rows = atoms.groupBy("pdb_id", "chain_run", "segment", "residue").agg(F.first("res_id").alias("res_id"), F.first("res_name").alias("res_name"), F.first("hetero").alias("hetero"))
    chain = W.partitionBy("pdb_id", "chain_run")
    kind = lambda names: F.size(F.collect_set(F.when(F.col("res_name").isin(*names), F.col("res_name"))).over(chain))
    after = F.lead("res_id").over(chain.orderBy("residue"))
    rows = rows.where("pdb_id IS NOT NULL").select("*", F.bool_or("hetero").over(chain).alias("_het"), kind(PROTEIN).alias("_p"), kind(DNA).alias("_d"), kind(RNA).alias("_r"), F.coalesce(after - F.col("res_id") - 1, F.lit(0)).alias("_gap"))
    p, d, r = F.col("_p"), F.col("_d"), F.col("_r")
    name = F.when((d > 0) & (d >= p) & (d >= r), MISSING["dna"]).when((r > 0) & (r >= p) & (r >= d), MISSING["rna"]).otherwise(MISSING["protein"])
    rows = rows.withColumn("_name", name)
    gap = F.when(F.col("_het"), 0).otherwise(F.greatest("_gap", F.lit(0)))
    listed = rows.select("pdb_id", "segment", "residue", "res_name", "_name", F.explode(F.sequence(F.lit(0), gap)).alias("_k"))
    num = F.row_number().over(W.partitionBy("pdb_id", "segment").orderBy("residue", "_k"))
    here = F.col("_k") == 0
    return listed.select("pdb_id", "segment", num.alias("num"), F.when(here, F.col("residue")).alias("residue"), F.when(here, F.col("res_name")).otherwise(F.col("_name")).alias("res_name"))


def _all_in(names: Column, known: tuple[str, ...]) -> Column:
    return F.forall(names, lambda n: n.isin(*known))


def poly_type(names: Column) -> Column:
    """The polymer that a list of residues makes: at least two of one kind and none of the two others; else null."""
    n = lambda known: F.size(F.filter(names, lambda x: x.isin(*known)))
    p, d, r = n(PROTEIN), n(DNA), n(RNA)
    return F.when((p >= 2) & (d == 0) & (r == 0), "polypeptide(L)").when((d >= 2) & (r == 0) & (p == 0), "polydeoxyribonucleotide").when((r >= 2) & (d == 0) & (p == 0), "polyribonucleotide")


def entities(residues: DataFrame) -> DataFrame:
    """pdb_id, segment, asym_id, entity_id (from 1, by first segment), turned, names, poly_type of each segment.

    Segments of equal names are one entity. A strand of DNA whose sequence is taken already is read from its other end (turned), as
    the second strand of a duplex; so of the strands that read alike in either direction the first stands as it is, the second becomes
    the other direction, and all later ones are turned.
    """
    made = residues.groupBy("pdb_id", "segment").agg(F.transform(F.sort_array(F.collect_list(F.struct("num", "res_name"))), lambda x: x["res_name"]).alias("names"))
    back = F.reverse("names")
    strand = _all_in(F.col("names"), DNA)
    # Arrays compare by their elements, so the lesser direction names both.
    made = made.withColumn("_dna", strand).withColumn("_both", F.when(strand, F.least("names", back)).otherwise(F.col("names")))
    alike = W.partitionBy("pdb_id", "_both").orderBy("segment")
    made = made.withColumn("_k", F.row_number().over(alike)).withColumn("_first", F.first("names").over(alike))
    turned = F.col("_dna") & ((F.col("_k") >= 3) | ((F.col("_k") == 2) & (F.col("names") == F.col("_first"))))
    made = made.withColumn("turned", turned).withColumn("names", F.when(F.col("turned"), back).otherwise(F.col("names")))
    made = made.withColumn("_from", F.min("segment").over(W.partitionBy("pdb_id", "names")))
    number = F.dense_rank().over(W.partitionBy("pdb_id").orderBy("_from"))
    return made.select("pdb_id", "segment", letters_of_number(F.col("segment")).alias("asym_id"), number.alias("entity_id"), "turned", "names", poly_type(F.col("names")).alias("poly_type"))


def inferred(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms with asym_id, entity_id and seq_id, and the segments that `entities` gives, of PDB lines (pdb_id, pos, line).

    Residues are numbered from 1 within their segment, missing ones included, and from the other end in turned strands. A file
    without atoms gives no row.
    """
    atoms = segments(first_model(lines))
    residues = filled_residues(atoms)
    made = entities(residues)
    number = F.when(F.col("turned"), F.size("names") + 1 - F.col("num")).otherwise(F.col("num"))
    seen = residues.where("residue IS NOT NULL").join(made, ["pdb_id", "segment"]).select("pdb_id", "segment", "residue", "asym_id", "entity_id", number.alias("seq_id"))
    return atoms.join(seen, ["pdb_id", "segment", "residue"]), made


def cif_tables(atoms: DataFrame, made: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """The categories of `CATEGORIES` with file and row, as `sources.mmcif.cif_text` takes them; only polymers have sequences."""
    file = F.col("pdb_id").alias("file")
    one = made.groupBy("pdb_id", "entity_id").agg(F.first("names").alias("names"), F.first("poly_type").alias("poly_type"))
    polymers = one.where("poly_type IS NOT NULL")
    entity = one.select(file, F.col("entity_id").alias("row"), F.col("entity_id").alias("id"), F.when(F.col("poly_type").isNull(), "non-polymer").otherwise("polymer").alias("type"))
    poly = polymers.select(file, F.col("entity_id").alias("row"), "entity_id", F.col("poly_type").alias("type"))
    seq = polymers.select(file, "entity_id", F.posexplode("names").alias("num", "mon_id")).select("file", "entity_id", (F.col("num") + 1).alias("num"), "mon_id", (F.col("entity_id").cast("long") * 1_000_000 + F.col("num")).alias("row"))
    asym = made.select(file, F.col("segment").alias("row"), F.col("asym_id").alias("id"), "entity_id")
    known = atoms.join(polymers.select("pdb_id", "entity_id", F.lit(True).alias("_poly")), ["pdb_id", "entity_id"], "left")
    serial = F.row_number().over(W.partitionBy("pdb_id").orderBy("segment", "seq_id", "pos"))
    text = lambda c, places: F.format_string(f"%.{places}f", F.col(c))
    bare = lambda c, blank: F.when(F.col(c) == "", blank).otherwise(F.col(c))
    sites = known.withColumn("id", serial).select(
        file, F.col("id").alias("row"), F.when(F.col("hetero"), "HETATM").otherwise("ATOM").alias("group_PDB"), "id", F.upper("element").alias("type_symbol"), F.col("atom_name").alias("label_atom_id"), bare("alt", ".").alias("label_alt_id"),
        F.col("res_name").alias("label_comp_id"), F.col("asym_id").alias("label_asym_id"), F.col("entity_id").alias("label_entity_id"), F.when(F.col("_poly"), F.col("seq_id").cast("string")).otherwise(".").alias("label_seq_id"), bare("ins", "?").alias("pdbx_PDB_ins_code"),
        text("x", 3).alias("Cartn_x"), text("y", 3).alias("Cartn_y"), text("z", 3).alias("Cartn_z"), text("occupancy", 2).alias("occupancy"), text("b", 2).alias("B_iso_or_equiv"),
        F.col("res_id").alias("auth_seq_id"), F.col("res_name").alias("auth_comp_id"), bare("chain_id", ".").alias("auth_asym_id"), F.lit(1).alias("pdbx_PDB_model_num"),
    )
    return {name: (df, CATEGORIES[name]) for name, df in (("entity", entity), ("entity_poly", poly), ("entity_poly_seq", seq), ("struct_asym", asym), ("atom_site", sites))}
