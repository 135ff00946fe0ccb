"""Template hits from a structure's categories to features of every hit, with errors as values.

Each step is a join or an aggregate over all hits at once; only the alignment of two sequences is a kernel, and each pair
of a query and a chain is aligned once however many hits name it. A chain's sequence and its atoms are bounded by the structure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.sequences import codes
from strandline.operators.structure import fix_arginine
from strandline.operators.templates import index_maps
from strandline.shared import materialise

# The heavy atoms that a protein residue can have, by their place in a residue's row of positions.
ATOMS = (
    "N", "CA", "C", "CB", "O", "CG", "CG1", "CG2", "OG", "OG1", "SG", "CD", "CD1", "CD2", "ND1", "ND2", "OD1", "OD2", "SD", "CE", "CE1", "CE2", "CE3", "NE", "NE1", "NE2", "OE1", "OE2", "CH2", "NH1",
    "NH2", "OH", "CZ", "CZ2", "CZ3", "NZ", "OXT",
)
#: Categories that `template_chains` reads.
CATEGORIES = {
    "atom_site": ["group_PDB", "label_atom_id", "label_comp_id", "label_asym_id", "label_seq_id", "label_alt_id", "auth_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "pdbx_PDB_model_num"],
    "entity_poly_seq": ["entity_id", "num", "mon_id"],
    "struct_asym": ["id", "entity_id"],
    "chem_comp": ["id", "type"],
    "pdbx_audit_revision_history": ["revision_date"],
}


def template_chains(tables: dict[str, DataFrame], letters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """structures (pdb_id, release_date), seqres (pdb_id, chain_id, place, letter) and atoms (pdb_id, chain_id, place, res_name, atom_name, x, y, z) of the protein chains of mmCIF categories.

    chain_id is the author's. A chain is protein if a component of its entity is of a peptide type, and is known if the first
    model has an atom of it; where an author's chain has several, the last listed one gives the sequence. place counts from the
    least number of the sequence. Of several places of an atom the one of greatest occupancy stays, then the first. The release is the
    earliest revision, null without one. letters: res_name, letter; other names, and letters of other lengths, are X.
    """
    file = F.col("file").alias("pdb_id")
    peptide = tables["chem_comp"].where(F.contains(F.col("type"), F.lit("peptide"))).select(file, F.col("id").alias("res_name")).distinct()
    listed = tables["entity_poly_seq"].select(file, "entity_id", F.col("num").try_cast("int").alias("num"), F.col("mon_id").alias("res_name"), "row")
    protein = listed.join(peptide, ["pdb_id", "res_name"], "left_semi").select("pdb_id", "entity_id").distinct()
    asym = tables["struct_asym"].select(file, F.col("id").alias("asym_id"), "entity_id", F.col("row").alias("asym_row")).join(protein, ["pdb_id", "entity_id"], "left_semi")
    sites = tables["atom_site"].where(F.col("pdbx_PDB_model_num") == "1").select(
        file, F.col("label_asym_id").alias("asym_id"), F.col("auth_asym_id").alias("chain_id"), F.col("label_seq_id").try_cast("int").alias("num"), F.col("label_comp_id").alias("res_name"), F.col("label_atom_id").alias("atom_name"),
        *[F.col(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"], F.coalesce(F.col("occupancy").try_cast("double"), F.lit(1.0)).alias("occupancy"), "row",
    )
    first = listed.groupBy("pdb_id", "entity_id").agg(F.min("num").alias("_first"))
    known = sites.select("pdb_id", "asym_id", "chain_id").distinct().join(asym, ["pdb_id", "asym_id"])
    last = known.groupBy("pdb_id", "chain_id").agg(F.max(F.struct("asym_row", "asym_id", "entity_id")).alias("l"))
    chains = last.select("pdb_id", "chain_id", "l.asym_id", "l.entity_id").join(first, ["pdb_id", "entity_id"])
    one = F.when(F.length("letter") == 1, F.col("letter")).otherwise("X").alias("letter")
    seqres = chains.join(listed, ["pdb_id", "entity_id"]).join(letters.select("res_name", "letter"), "res_name", "left")
    # Of alternatives at one number the first listed stands for the place.
    seqres = seqres.groupBy("pdb_id", "chain_id", (F.col("num") - F.col("_first")).alias("place")).agg(F.min_by(one, "row").alias("letter"))
    spot = sites.join(chains, ["pdb_id", "chain_id", "asym_id"]).withColumn("place", F.col("num") - F.col("_first")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND place IS NOT NULL")
    best = spot.groupBy("pdb_id", "chain_id", "place", "atom_name").agg(F.min_by(F.struct("res_name", "x", "y", "z"), F.struct(-F.col("occupancy"), "row")).alias("a"))
    atoms = best.select("pdb_id", "chain_id", "place", "a.res_name", "atom_name", "a.x", "a.y", "a.z")
    files = tables["atom_site"].select(file).distinct()
    dates = tables["pdbx_audit_revision_history"].groupBy(file).agg(F.min(F.col("revision_date").try_cast("date")).alias("release_date"))
    return files.join(dates, "pdb_id", "left"), seqres, atoms


def chain_positions(atoms: DataFrame, centre: bool = True) -> DataFrame:
    """pdb_id, chain_id, place, atom (its place in ATOMS), x, y, z: heavy atoms, selenium as sulphur, arginines in order, about the chain's mean."""
    sulphur = (F.col("res_name") == "MSE") & (F.upper("atom_name") == "SE")
    rows = atoms.select("pdb_id", "chain_id", F.col("place").alias("res_id"), "res_name", F.when(sulphur, "SD").otherwise(F.col("atom_name")).alias("atom_name"), "x", "y", "z").where(F.col("atom_name").isin(*ATOMS))
    rows = fix_arginine(rows).select("pdb_id", "chain_id", F.col("res_id").alias("place"), (F.array_position(F.array(*[F.lit(a) for a in ATOMS]), F.col("atom_name")) - 1).cast("int").alias("atom"), "x", "y", "z")
    if not centre:
        return rows
    mean = rows.groupBy("pdb_id", "chain_id").agg(*[F.avg(c).alias(f"m_{c}") for c in "xyz"])
    return rows.join(mean, ["pdb_id", "chain_id"]).select("pdb_id", "chain_id", "place", "atom", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in "xyz"])


def broken_chains(positions: DataFrame, most: float) -> DataFrame:
    """pdb_id, chain_id in which a CA and the next observed one lie further apart than most."""
    after = W.partitionBy("pdb_id", "chain_id").orderBy("place")
    step = sum((F.pow(F.lead(c).over(after) - F.col(c), 2) for c in "xyz"), F.lit(0.0))
    steps = positions.where(F.col("atom") == ATOMS.index("CA")).select("pdb_id", "chain_id", step.alias("_d"))
    return steps.where(F.col("_d") > most * most).select("pdb_id", "chain_id").distinct()


def process(
    hits: DataFrame, structures: DataFrame, seqres: DataFrame, atoms: DataFrame, latest: str, obsolete: DataFrame | None = None, strict: bool = False, centre: bool = True, most_step: float = 150.0, least_atoms: int = 5
) -> tuple[DataFrame, DataFrame]:
    """What becomes of every hit, and the features of those that have some.

    hits: query, hit, query_seq, pdb_id, chain_id, sum_probs, one row for each (query, hit), with one query_seq for each query;
    obsolete: pdb_id, replaced_by. Results: query, hit, pdb_id and chain_id as used, has_features, error, aligned_cols, sequence (the
    template's letters under the query, - where there is none), codes, atoms, sum_probs (null as 0), release_date. error is the first of
    load (no such structure), parse (no protein chain), date (later than latest; told only if strict, a missing date counts as last),
    chain (not there, nor the only one), align (no query), distance (broken chain), atoms (fewer than least_atoms).
    Hits with their chains, alignments and positions are written once each, as later steps read them several times.
    Features: query, hit, place (in the query), template_place, positions (atom, x, y, z). A hit without a query or structure id has error load.
    """
    used = F.col("pdb_id")
    rows = hits.select("query", "hit", "query_seq", "pdb_id", F.col("chain_id").alias("_asked"), "sum_probs")
    if obsolete is not None:
        rows = rows.join(obsolete.groupBy("pdb_id").agg(F.max("replaced_by").alias("_new")), "pdb_id", "left")
        used = F.coalesce("_new", "pdb_id").alias("pdb_id")
        rows = rows.select("query", "hit", "query_seq", used, "_asked", "sum_probs")
    wanted = rows.select("pdb_id").distinct()
    letters = F.transform(F.sort_array(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"])
    chains = seqres.join(wanted, "pdb_id", "left_semi").groupBy("pdb_id", "chain_id").agg(F.array_join(letters, "").alias("_seq"))
    alone = chains.groupBy("pdb_id").agg(F.count(F.lit(1)).alias("_n"), F.first("chain_id").alias("_only"))
    rows = rows.join(structures.select("pdb_id", "release_date", F.lit(True).alias("_there")), "pdb_id", "left").join(alone, "pdb_id", "left")
    rows = rows.join(chains.select("pdb_id", F.col("chain_id").alias("_asked"), F.lit(True).alias("_has")), ["pdb_id", "_asked"], "left")
    chain = F.when(F.col("_has"), F.col("_asked")).when(F.col("_n") == 1, F.col("_only"))
    late = F.coalesce(F.col("release_date"), F.lit("9999-12-31").cast("date")) > F.lit(latest).cast("date")
    early = F.when(F.col("_there").isNull() | F.col("query").isNull(), "load").when(F.col("_n").isNull(), "parse").when(late, "date").when(F.col("chain_id").isNull(), "chain").when(F.coalesce(F.length("query_seq"), F.lit(0)) == 0, "align")
    rows = materialise(rows.select("query", "hit", "query_seq", "pdb_id", "sum_probs", "release_date", chain.alias("chain_id"), early.alias("_error")), "template-hits")

    # One alignment for each query and chain.
    open_hits = rows.where("_error IS NULL")
    keys = ["query", "pdb_id", "chain_id"]
    pairs = open_hits.groupBy(*keys).agg(F.max("query_seq").alias("query_seq")).join(chains, ["pdb_id", "chain_id"])
    found = index_maps(pairs.select("query", F.struct("pdb_id", "chain_id").alias("hit"), "query_seq", F.col("_seq").alias("hit_seq")), 0.0)
    found = materialise(found.select("query", "hit.pdb_id", "hit.chain_id", "mapping").join(pairs.select(*keys, "query_seq", "_seq"), keys), "template-maps")

    positions = materialise(chain_positions(atoms.join(open_hits.select("pdb_id", "chain_id").distinct(), ["pdb_id", "chain_id"], "left_semi"), centre), "template-positions")
    broken = broken_chains(positions, most_step).withColumn("_broken", F.lit(True))
    residues = positions.groupBy("pdb_id", "chain_id", F.col("place").alias("template_place")).agg(F.sort_array(F.collect_list(F.struct("atom", "x", "y", "z"))).alias("positions"))
    placed = found.select(*keys, F.explode("mapping").alias("place", "template_place")).join(residues, ["pdb_id", "chain_id", "template_place"])
    counts = placed.groupBy(*keys).agg(F.sum(F.size("positions")).alias("atoms"))
    under = F.transform(F.sequence(F.lit(0), F.length("query_seq") - 1), lambda i: F.coalesce(F.substring(F.col("_seq"), F.try_element_at("mapping", i) + 1, F.lit(1)), F.lit("-")))
    made = found.withColumn("sequence", F.array_join(under, "")).select(*keys, F.size("mapping").alias("aligned_cols"), "sequence").join(counts, keys, "left").join(broken, ["pdb_id", "chain_id"], "left")

    out = rows.join(made, keys, "left")
    few = F.coalesce("atoms", F.lit(0)) < least_atoms
    out = out.withColumn("_error", F.coalesce("_error", F.when(F.col("_broken"), "distance").when(few, "atoms")))
    fine = F.col("_error").isNull()
    told = F.col("_error") if strict else F.when(F.col("_error") != "date", F.col("_error"))
    kept = lambda c: F.when(fine, c)
    results = out.select(
        "query", "hit", "pdb_id", kept(F.col("chain_id")).alias("chain_id"), fine.alias("has_features"), told.alias("error"), *[kept(F.col(c)).alias(c) for c in ("aligned_cols", "sequence")],
        kept(codes(F.col("sequence"))).alias("codes"), kept(F.col("atoms")).alias("atoms"), kept(F.coalesce("sum_probs", F.lit(0.0))).alias("sum_probs"), kept(F.col("release_date")).alias("release_date"),
    )
    good = out.where(fine).select("query", "hit", "pdb_id", "chain_id")
    return results, good.join(placed, keys).select("query", "hit", "place", "template_place", "positions")
