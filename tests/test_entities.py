"""Entities, components and PDB text against small examples worked out by hand."""

import pytest

from strandline.operators import entities, structure


def components(spark):
    rows = [("ALA", "A", "L-PEPTIDE LINKING"), ("GLY", "G", "peptide linking"), ("DT", "T", "DNA LINKING"), ("U", "U", "RNA LINKING"), ("XXY", "THG", "RNA LINKING"), ("HEM", "?", "NON-POLYMER"), ("PLK", "?", "PEPTIDE-LIKE")]
    return spark.createDataFrame(rows, "res_name string, letter string, link_type string")


def test_letters_types_and_sequences(spark):
    names = ["ALA", "DT", "U", "XXY", "HEM", "PLK", "NONE", "GLY"]
    rows = spark.createDataFrame([("e", i, n) for i, n in enumerate(names)], "entity string, pos int, res_name string")
    assert entities.sequences(rows, components(spark), ["entity"]).first()["sequence"] == "ATUXXXXG"
    got = {r["res_name"]: r["mol_type"] for r in entities.with_molecule_type(rows, components(spark)).collect()}
    assert got == {"ALA": "protein", "GLY": "protein", "DT": "dna", "U": "rna", "XXY": "rna", "HEM": "ligand", "PLK": "ligand", "NONE": "ligand"}


def test_polymer_residues(spark):
    listed = spark.createDataFrame([("1", 1, 0, "MSE"), ("1", 2, 0, "SER"), ("1", 2, 1, "THR"), ("1", 3, 0, "ALA"), ("1", 3, 1, "GLY")], "entity string, pos int, alternative int, res_name string")
    observed = spark.createDataFrame([("1", 2, "THR"), ("1", 2, "THR")], "entity string, pos int, res_name string")
    assert {r["pos"]: r["res_name"] for r in entities.polymer_residues(listed, observed, ["entity"]).collect()} == {1: "MET", 2: "THR", 3: "ALA"}


def test_categories(spark):
    exptl = spark.createDataFrame([("f", "X-RAY DIFFRACTION"), ("f", "NEUTRON DIFFRACTION"), ("g", "SOLUTION NMR")], "file string, method string")
    assert {r["file"]: r["methods"] for r in entities.methods(exptl).collect()} == {"f": ["NEUTRON DIFFRACTION", "X-RAY DIFFRACTION"], "g": ["SOLUTION NMR"]}
    poly = spark.createDataFrame([("f", "1", "polypeptide(L)"), ("f", "2", "polyribonucleotide")], "file string, entity_id string, type string")
    assert entities.polymer_types(poly).first()["poly_types"] == {"1": "polypeptide(L)", "2": "polyribonucleotide"}
    entity = spark.createDataFrame([("f", "1", "polymer", "  A chain ", "2")], "file string, id string, type string, pdbx_description string, pdbx_number_of_molecules string")
    assert tuple(entities.entity_infos(entity).first()["info"]) == ("polymer", "A chain", "2")


def test_aids_and_pseudo_beta(spark):
    atoms = spark.createDataFrame([("p", "1", 1, "GOL", "C1", 1.0), ("p", "2", 2, "GOL", "C1", 2.0), ("p", "2", 3, "ATP", "C1", 3.0)], "pdb_id string, entity_id string, res_id int, res_name string, atom_name string, x double")
    left = entities.remove_aids(atoms, spark.createDataFrame([("p", "1")], "pdb_id string, entity_id string"), ("GOL", "SO4"))
    assert sorted((r["entity_id"], r["res_name"]) for r in left.collect()) == [("1", "GOL"), ("2", "ATP")]
    rows = [(1, "GLY", "CA", 1.0), (1, "GLY", "CB", 9.0), (2, "ALA", "CA", 2.0), (2, "ALA", "CB", 3.0), (3, "ALA", "CA", 4.0)]
    df = spark.createDataFrame([(*r, 0.5, 0.5) for r in rows], "res_id int, res_name string, atom_name string, x double, y double, z double")
    assert {r["res_id"]: (r["x"], r["mask"]) for r in entities.pseudo_beta(df, ["res_id"]).collect()} == {1: (1.0, 1), 2: (3.0, 1), 3: (0.0, 0)}


def test_molecules_and_tokens(spark):
    d = spark.createDataFrame([("p", i, i == 4, float(9 - i)) for i in range(6)] + [("q", 0, False, 1.0)], "pdb_id string, mol_id int, is_core boolean, d double")
    assert sorted((r["pdb_id"], r["mol_id"]) for r in entities.nearest_molecules(d, 3).collect()) == [("p", 3), ("p", 4), ("p", 5), ("q", 0)]
    pairs = spark.createDataFrame([("p", 1, 2, 2.0, 8.0), ("p", 2, 1, 3.0, 9.0)], "pdb_id string, i int, j int, least double, most double")
    assert {tuple(r) for r in entities.contact_atom_pairs(pairs).collect()} == {("p", 1, 2, 3.0, 8.0), ("p", 2, 1, 3.0, 8.0)}
    tokens = spark.createDataFrame([("p", 0, True, False), ("p", 1, True, False), ("p", 2, False, True)], "pdb_id string, token long, is_standard boolean, is_ligand boolean")
    atoms = spark.createDataFrame([("p", i, t) for i, t in enumerate([0, 0, 1, 1, 2])], "pdb_id string, atom_idx long, token long")
    out = entities.atom_tokens(tokens, atoms, spark.createDataFrame([("p", 1), ("p", 2)], "pdb_id string, token long"))
    assert sorted(tuple(r) for r in out.select("old", "new", "atom_idx").collect()) == [(0, 0, None), (1, 1, 2), (1, 2, 3), (2, 3, None)]


def test_pdb_text_round_trip(spark):
    rows = [("p", 1, "CA", "ALA", "A", 12, 1.25, -3.5, 100.0, "C"), ("p", 2, "HG11", "VAL", "B", 1, 0.0, 0.001, -999.999, "H")]
    atoms = spark.createDataFrame(rows, "pdb_id string, atom_idx long, atom_name string, res_name string, chain_id string, res_id long, x double, y double, z double, element string")
    lines = entities.pdb_lines(atoms)
    assert {len(r["line"]) for r in lines.collect()} == {78}
    assert sorted(tuple(r) for r in entities.atoms_of_pdb(lines).collect()) == rows
    with pytest.raises(Exception, match="does not fit"):
        entities.pdb_lines(atoms.replace({"A": "AA"}, subset=["chain_id"])).collect()


def test_chains_by_entity(spark):
    chains = [("A", "2", 2), ("B", "10", 1), ("C", "2", 3), ("D", "2", 2)]
    rows = [("p", c, e) for c, e, n in chains for _ in range(n)]
    atoms = spark.createDataFrame([(p, c, e, i) for i, (p, c, e) in enumerate(rows)], "pdb_id string, chain_id string, entity_id string, atom_idx long")
    got = sorted((r["place"], r["chain_id"], r["atom_idx"]) for r in structure.chains_by_entity(atoms).collect())
    assert got == [(0, "B", 2), (1, "C", 3), (2, "C", 4), (3, "C", 5), (4, "A", 0), (5, "A", 1), (6, "D", 6), (7, "D", 7)]


def test_polymer_frames(spark):
    rows = [(0, "protein", "C", 2), (0, "protein", "N", 0), (0, "protein", "CA", 1), (1, "protein", "CA", 3), (2, "rna", "C1'", 4), (2, "rna", "C3'", 5), (2, "rna", "C4'", 6), (2, "rna", "N", 7), (3, "dna", "N", 8)]
    atoms = spark.createDataFrame([("p", *r) for r in rows], "pdb_id string, token int, mol_type string, atom_name string, atom_idx long")
    got = {r["token"]: (r["has_frame"], r["frame"]) for r in structure.polymer_frames(atoms).collect()}
    assert got == {0: (1, [0, 1, 2]), 1: (0, [-1] * 3), 2: (1, [4, 5, 6]), 3: (0, [-1] * 3)}
