"""Bonds of structures read from mmCIF: within components, of struct_conn, and between the residues of a polymer.

All joins are on (pdb_id, keys of an atom), so structures are spread over the cluster; the only windows are over the residues of one
structure. Structures with more than `most_atoms` atoms are left out.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.shared import materialise

# The connection types of struct_conn that are covalent, and the symmetry operation that changes nothing.
COVALENT = ("covale", "covale_base", "covale_phosphate", "covale_sugar", "disulf", "modres", "modres_link")
IDENTITY = "1_555"
AXES = ("x", "y", "z")


def _text(name: str) -> Column:
    """A cell with one form for what is missing."""
    return F.when(F.col(name) == "?", ".").otherwise(F.col(name))


def atoms_of_model(sites: DataFrame, model: int = 1, most_atoms: int = 1_000_000) -> DataFrame:
    """Typed atoms of one model of each structure, in the order of the file; model counts from 1, or from the end if negative.

    A structure without that model, or with more than most_atoms atoms, has no rows. A file without model numbers has one model.
    """
    if model == 0:
        raise ValueError("models count from 1, or from -1 at the end")
    number = F.coalesce(F.col("pdbx_PDB_model_num"), F.lit("1"))
    rows = sites.withColumn("model", number)
    models = rows.groupBy("file", "model").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("n"))
    order = F.asc("start") if model > 0 else F.desc("start")
    models = models.withColumn("nth", F.row_number().over(W.partitionBy("file").orderBy(order))).withColumn("all", F.sum("n").over(W.partitionBy("file")))
    chosen = models.where((F.col("nth") == abs(model)) & (F.col("all") <= most_atoms)).select("file", "model")
    n = lambda c: F.col(c).try_cast("double")
    return rows.join(chosen, ["file", "model"]).select(
        F.col("file").alias("pdb_id"), F.col("row").alias("atom_idx"), F.col("id").try_cast("long").alias("site_id"), F.col("type_symbol").alias("element"), F.col("label_atom_id").alias("atom_name"), _text("label_alt_id").alias("alt_id"),
        F.col("label_comp_id").alias("res_name"), F.col("label_asym_id").alias("chain_id"), F.col("label_entity_id").alias("entity_id"), F.col("label_seq_id").try_cast("int").alias("res_id"), _text("pdbx_PDB_ins_code").alias("ins_code"),
        F.col("auth_asym_id").alias("auth_chain"), F.col("auth_seq_id").try_cast("int").alias("auth_res"), F.col("auth_comp_id").alias("auth_name"), n("occupancy").alias("occupancy"), n("B_iso_or_equiv").alias("b_factor"),
        n("pdbx_formal_charge").cast("int").alias("charge"), n("Cartn_x").alias("x"), n("Cartn_y").alias("y"), n("Cartn_z").alias("z"),
    )


def _distance() -> Column:
    return F.sqrt(sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2)) for c in AXES), F.lit(0.0)))


def connections(atoms: DataFrame, conn: DataFrame, longest: float | None = 2.4) -> DataFrame:
    """pdb_id, i, j, d, kind, order of the covalent rows of struct_conn within the asymmetric unit, shorter than `longest`.

    An end is found by all the columns that both tables hold. Rows with an end that is in no atom (of another model, say) are
    left out, and so are those with one that fits several atoms, as alternative places do; `ambiguous` lists these.
    """
    met = _met(atoms, conn)
    once = met.where("ni = 1 AND nj = 1")
    return once.select("pdb_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d", F.lit("conn").alias("kind"), F.lit(1).alias("order")).where(F.lit(True) if longest is None else F.col("d") < longest).distinct()


def ambiguous(atoms: DataFrame, conn: DataFrame) -> DataFrame:
    """pdb_id, id of covalent rows of struct_conn with an end that fits several atoms."""
    return _met(atoms, conn).where("ni > 1 OR nj > 1").select("pdb_id", "id").distinct()


def _met(atoms: DataFrame, conn: DataFrame) -> DataFrame:
    sym = lambda k: F.coalesce(F.when(_text(f"ptnr{k}_symmetry") == ".", IDENTITY).otherwise(F.col(f"ptnr{k}_symmetry")), F.lit(IDENTITY)) == IDENTITY
    rows = conn.where(F.col("conn_type_id").isin(*COVALENT) & sym(1) & sym(2)).withColumnRenamed("file", "pdb_id")
    places = atoms.select("pdb_id", "atom_idx", *AXES, "chain_id", "res_name", "atom_name", F.coalesce(F.col("res_id").cast("string"), F.lit(".")).alias("res_id"), "alt_id", "ins_code", "auth_chain", "auth_name", F.col("auth_res").cast("string").alias("auth_res"))
    for k, end in ((1, "i"), (2, "j")):
        names = {"chain_id": f"ptnr{k}_label_asym_id", "res_name": f"ptnr{k}_label_comp_id", "atom_name": f"ptnr{k}_label_atom_id"}
        further = {"res_id": f"ptnr{k}_label_seq_id", "alt_id": f"pdbx_ptnr{k}_label_alt_id", "ins_code": f"pdbx_ptnr{k}_PDB_ins_code", "auth_chain": f"ptnr{k}_auth_asym_id", "auth_name": f"ptnr{k}_auth_comp_id", "auth_res": f"ptnr{k}_auth_seq_id"}
        q, p = rows.alias("q"), places.alias("p")
        on = [F.col("q.pdb_id") == F.col("p.pdb_id"), *[F.col(f"q.{c}") == F.col(f"p.{n}") for n, c in names.items()]]
        on += [F.coalesce(F.when(F.col(f"q.{c}") == "?", ".").otherwise(F.col(f"q.{c}")) == F.col(f"p.{n}"), F.lit(True)) for n, c in further.items()]
        kept = [c for c in rows.columns if c not in (*names.values(), *further.values())]
        rows = q.join(p, reduce(and_, on)).select(*[F.col(f"q.{c}") for c in kept], F.col("p.atom_idx").alias(end), *[F.col(f"p.{c}").alias(f"{end}_{c}") for c in AXES])
    by = W.partitionBy("pdb_id", "row")
    d = F.sqrt(sum((F.pow(F.col(f"i_{c}") - F.col(f"j_{c}"), F.lit(2)) for c in AXES), F.lit(0.0)))
    return rows.select("pdb_id", "row", "id", "i", "j", d.alias("d")).withColumn("ni", F.size(F.collect_set("i").over(by))).withColumn("nj", F.size(F.collect_set("j").over(by)))


# Bond orders of chem_comp_bond.
ORDERS = {"sing": 1, "doub": 2, "trip": 3, "quad": 4, "arom": 1}


def within_components(atoms: DataFrame, comp_bonds: DataFrame) -> DataFrame:
    """pdb_id, i, j, d, kind, order of bonds within residues, by the components that the files describe."""
    residue = ["pdb_id", "auth_chain", "auth_res", "ins_code", "chain_id", "res_name"]
    order = F.coalesce(*[F.when(F.lower("value_order") == k, v) for k, v in ORDERS.items()])
    pairs = comp_bonds.select(F.col("file").alias("pdb_id"), F.col("comp_id").alias("res_name"), "atom_id_1", "atom_id_2", order.alias("order")).distinct()
    a = atoms.select(*residue, "atom_name", "atom_idx", *AXES)
    one = a.withColumnRenamed("atom_name", "atom_id_1").join(pairs, ["pdb_id", "res_name", "atom_id_1"])
    two = a.withColumnRenamed("atom_name", "atom_id_2")
    on = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*residue, "atom_id_2")])
    both = one.alias("a").join(two.alias("b"), on).where("a.atom_idx <> b.atom_idx")
    return both.select("a.pdb_id", F.least("a.atom_idx", "b.atom_idx").alias("i"), F.greatest("a.atom_idx", "b.atom_idx").alias("j"), _distance().alias("d"), F.lit("component").alias("kind"), "a.order").distinct()


def _residue_places(atoms: DataFrame, chain: str, res: str) -> DataFrame:
    """pdb_id, atom_idx, chain, place (number of its residue in the file), atom_name."""
    inner = W.partitionBy("pdb_id").orderBy("atom_idx")
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(inner))
    starts = (changed(chain) | changed(res) | changed("ins_code") | changed("res_name")).cast("int")
    return atoms.withColumn("_s", starts).select("pdb_id", "atom_idx", F.col(chain).alias("chain"), "atom_name", F.sum("_s").over(inner.rowsBetween(W.unboundedPreceding, 0)).alias("place"))


def polymer_links(atoms: DataFrame, comps: DataFrame, chain: str = "chain_id", res: str = "res_id", longest_between_chains: float | None = None) -> DataFrame:
    """pdb_id, i, j, d, end, far: C to N, or O3' to P, of residues that follow one another in a chain.

    The next residue in the file counts if it is of the same chain and its number is at most one higher. comps
    has file, id, type; types with PEPTIDE (but peptide-like ones), DNA or RNA link. Of alternative places the first counts.
    far marks links between two label chains that are longer than longest_between_chains.
    """
    kind = F.upper("type")
    types = comps.select(F.col("file").alias("pdb_id"), F.col("id").alias("res_name"), F.when(kind.contains("PEPTIDE") & (kind != "PEPTIDE-LIKE"), "protein").when(kind.contains("DNA") | kind.contains("RNA"), "nucleic").alias("type"))
    types = types.groupBy("pdb_id", "res_name").agg(F.max("type").alias("type"))
    label = atoms.select("pdb_id", "atom_idx", "res_name", F.col("chain_id").alias("label"), F.col(res).alias("res"), *AXES)
    placed = _residue_places(atoms, chain, res).join(label, ["pdb_id", "atom_idx"])
    point = lambda name: F.min(F.when(F.col("atom_name") == name, F.struct("atom_idx", *AXES, "label")))
    residues = placed.groupBy("pdb_id", "place").agg(F.first("chain").alias("chain"), F.first("res").alias("res"), F.first("res_name").alias("res_name"), point("C").alias("c"), point("N").alias("n"), point("O3'").alias("o"), point("P").alias("p"))
    residues = residues.join(types, ["pdb_id", "res_name"], "left")
    a, b = residues.alias("a"), residues.withColumn("place", F.col("place") - 1).alias("b")
    near = a.join(b, (F.col("a.pdb_id") == F.col("b.pdb_id")) & (F.col("a.place") == F.col("b.place")) & (F.col("a.chain") == F.col("b.chain")) & (F.col("a.type") == F.col("b.type")) & (F.col("b.res") - F.col("a.res") <= 1))
    ends = near.select("a.pdb_id", F.when(F.col("a.type") == "protein", F.col("a.c")).otherwise(F.col("a.o")).alias("a"), F.when(F.col("b.type") == "protein", F.col("b.n")).otherwise(F.col("b.p")).alias("b"), F.col("a.type").alias("type"))
    ends = ends.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", _distance())
    far = F.lit(False) if longest_between_chains is None else (F.col("a.label") != F.col("b.label")) & (F.col("d") > longest_between_chains)
    # The end that an unusual link would take: N of a protein, O3' of a nucleic acid.
    open_end = F.when(F.col("type") == "protein", F.col("b.atom_idx")).otherwise(F.col("a.atom_idx"))
    return ends.select("pdb_id", F.col("a.atom_idx").alias("i"), F.col("b.atom_idx").alias("j"), "d", open_end.alias("end"), far.alias("far"))


def add_polymer_bonds(bonds: DataFrame, atoms: DataFrame, comps: DataFrame, chain: str = "chain_id", res: str = "res_id", longest_between_chains: float | None = None) -> DataFrame:
    """bonds (pdb_id, i, j, d, kind, order) with the polymer's own links, but where another bond takes their place.

    A link is left out, and taken out of bonds, if its N (or O3') is bonded already to an atom of a neighbouring residue of the
    chain that is no C or P, or if it is far.
    """
    links = materialise(polymer_links(atoms, comps, chain, res, longest_between_chains), "links")
    at = _residue_places(atoms, chain, res)
    both = bonds.select("pdb_id", F.col("i").alias("end"), F.col("j").alias("other")).unionByName(bonds.select("pdb_id", F.col("j").alias("end"), F.col("i").alias("other")))
    taken = links.select("pdb_id", "end").distinct().join(both, ["pdb_id", "end"])
    own, far = at.select("pdb_id", F.col("atom_idx").alias("end"), F.col("chain").alias("c1"), F.col("place").alias("p1")), at.select("pdb_id", F.col("atom_idx").alias("other"), F.col("chain").alias("c2"), F.col("place").alias("p2"), "atom_name")
    taken = taken.join(own, ["pdb_id", "end"]).join(far, ["pdb_id", "other"]).where("c1 = c2 AND abs(p1 - p2) = 1 AND atom_name NOT IN ('C', 'P')").select("pdb_id", "end", F.lit(True).alias("taken")).distinct()
    judged = links.join(taken, ["pdb_id", "end"], "left").withColumn("out", F.coalesce("taken", F.lit(False)) | F.col("far"))
    judged = judged.select("pdb_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d", "out")
    # One pass over both: a pair that is out goes, and a known bond stays what it is.
    known = bonds.select("pdb_id", "i", "j", F.struct(F.lit(0).alias("_first"), "d", "kind", F.col("order").cast("int").alias("order")).alias("b"), F.lit(False).alias("out"))
    added = judged.select("pdb_id", "i", "j", F.struct(F.lit(1).alias("_first"), "d", F.lit("polymer").alias("kind"), F.lit(1).alias("order")).alias("b"), "out")
    both = known.unionByName(added).groupBy("pdb_id", "i", "j").agg(F.min("b").alias("b"), F.bool_or("out").alias("out"))
    return both.where("NOT out").select("pdb_id", "i", "j", "b.d", "b.kind", "b.order")


def structure_bonds(tables: dict[str, DataFrame], model: int = 1, longest: float | None = 2.4, most_atoms: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds (pdb_id, i, j, d, kind, order; i < j) of the structures whose mmCIF tables are given.

    A bond that components and struct_conn both have counts as the component's. Polymer links are found by the authors' numbers
    first, those between label chains only within 2.5, and then by label numbers, which fill what the authors' numbering tears.
    """
    atoms = materialise(atoms_of_model(tables["atom_site"], model, most_atoms), "atoms")
    inside = within_components(atoms, tables["chem_comp_bond"])
    conn = connections(atoms, tables["struct_conn"], longest)
    known = inside.withColumn("_first", F.lit(0)).unionByName(conn.withColumn("_first", F.lit(1)))
    known = known.groupBy("pdb_id", "i", "j").agg(F.min(F.struct("_first", "d", "kind", "order")).alias("b")).select("pdb_id", "i", "j", "b.d", "b.kind", "b.order")
    bonds = add_polymer_bonds(materialise(known, "bonds"), atoms, tables["chem_comp"], "auth_chain", "auth_res", 2.5)
    return atoms, add_polymer_bonds(materialise(bonds, "bonds"), atoms, tables["chem_comp"])
