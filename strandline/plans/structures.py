"""Named queries over structures that are written as mmCIF and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import bonds, reference_chains
from strandline.plans.catalogue import query
from strandline.plans.views import table
from strandline.shared import shared_folder
from strandline.sources import mmcif

SITE = ["id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "label_entity_id", "label_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "auth_seq_id", "auth_comp_id", "auth_asym_id", "pdbx_PDB_model_num"]
CONN = ["id", "conn_type_id", "ptnr1_label_asym_id", "ptnr1_label_comp_id", "ptnr1_label_seq_id", "ptnr1_label_atom_id", "ptnr1_symmetry", "ptnr2_label_asym_id", "ptnr2_label_comp_id", "ptnr2_label_seq_id", "ptnr2_label_atom_id", "ptnr2_symmetry"]
_NAMES = ("N", "CA", "C", "O")


def cif_files(spark, sf_dir) -> str:
    """Folder of mmCIF files with many data blocks: a block for every 64 vectors, chains A to C of four alanines and chain D of four ligand residues, in two models; four connections each."""
    v, e = F.col("vec_id"), F.col("embedding")
    t = F.floor(v % 64 / 4)
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (t % 4 + 1).cast("int"))
    coordinate = lambda i: F.format_string("%.3f", e[i].cast("double") * 8 + F.floor(t / 4) * 2)
    chain = v % 4
    sites = table(spark, sf_dir, "embeddings").select(
        F.floor(v / 64).alias("file"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pdbx_PDB_model_num"), v, name.alias("label_atom_id"), F.substring(name, 1, 1).alias("type_symbol"), F.lit(".").alias("label_alt_id"),
        F.when(chain == 3, "LIG").otherwise("ALA").alias("label_comp_id"), F.chr(chain + 65).alias("label_asym_id"), (chain + 1).alias("label_entity_id"), (F.floor(t / 4) + 1).alias("label_seq_id"), F.lit("?").alias("pdbx_PDB_ins_code"),
        coordinate(0).alias("Cartn_x"), coordinate(1).alias("Cartn_y"), coordinate(2).alias("Cartn_z"), F.lit("1.00").alias("occupancy"), chain.alias("_c"), t.alias("_t"),
    )
    # Atoms of a file by model, chain and place.
    row = (F.col("pdbx_PDB_model_num") - 1) * 64 + F.col("_c") * 16 + F.col("_t")
    sites = sites.withColumn("row", row).withColumn("id", row + 1).withColumn("auth_seq_id", F.col("label_seq_id") + 10).withColumn("auth_comp_id", F.col("label_comp_id")).withColumn("auth_asym_id", F.col("label_asym_id"))
    files = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("file")).distinct()
    conn = [  # type, ends, symmetry of the second
        ("covale", "A", "ALA", 1, "CA", "D", "LIG", 1, "O", "1_555"),
        ("covale", "B", "ALA", 2, "N", "B", "ALA", 1, "CA", "1_555"),  # takes the place of the link to C
        ("disulf", "A", "ALA", 2, "CA", "B", "ALA", 2, "CA", "2_655"),
        ("metalc", "C", "ALA", 1, "O", "D", "LIG", 2, "O", "1_555"),
    ]
    parts = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(f"c{i}").alias("id"), *[F.lit(x).alias(n) for n, x in zip(("conn_type_id", "ptnr1_label_asym_id", "ptnr1_label_comp_id", "ptnr1_label_seq_id", "ptnr1_label_atom_id", "ptnr2_label_asym_id", "ptnr2_label_comp_id", "ptnr2_label_seq_id", "ptnr2_label_atom_id", "ptnr2_symmetry"), c)], F.lit("1_555").alias("ptnr1_symmetry")) for i, c in enumerate(conn)])
    inline = lambda *rows: files.select("file", F.inline(F.array(*[F.struct(F.lit(i).alias("row"), *[F.lit(x).alias(n) for n, x in r.items()]) for i, r in enumerate(rows)])))
    comps = inline({"id": "ALA", "type": "L-peptide linking"}, {"id": "LIG", "type": "non-polymer"})
    pairs = inline(*[{"comp_id": c, "atom_id_1": a, "atom_id_2": b, "value_order": "DOUB" if b == "O" else "SING"} for c in ("ALA", "LIG") for a, b in zip(_NAMES, _NAMES[1:])])
    path = shared_folder(spark, "structures")
    text = mmcif.cif_text({
        "atom_site": (sites, SITE), "struct_conn": (files.select("file", F.inline(parts)), CONN), "chem_comp": (comps, ["id", "type"]), "chem_comp_bond": (pairs, ["comp_id", "atom_id_1", "atom_id_2", "value_order"]),
    })
    mmcif.write_blocks(text, path)
    return path


_SITES = """
v_sites AS (SELECT vec_id // 64 AS s, vec_id % 4 AS c, vec_id % 64 // 4 // 4 + 1 AS r, ['N', 'CA', 'C', 'O'][vec_id % 64 // 4 % 4 + 1] AS a, vec_id % 4 * 16 + vec_id % 64 // 4 AS i,
  printf('%.3f', embedding[1]::DOUBLE * 8 + vec_id % 64 // 16 * 2)::DOUBLE AS x, printf('%.3f', embedding[2]::DOUBLE * 8 + vec_id % 64 // 16 * 2)::DOUBLE AS y, printf('%.3f', embedding[3]::DOUBLE * 8 + vec_id % 64 // 16 * 2)::DOUBLE AS z FROM embeddings)"""


@query(
    "WITH "
    + _SITES.strip()
    + """, p AS (SELECT a.s, a.i AS i, b.i AS j, a.c AS ca, b.c AS cb, a.r AS ra, b.r AS rb, a.a AS na, b.a AS nb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM v_sites a JOIN v_sites b ON a.s = b.s AND a.i <> b.i),
w AS (SELECT s, i, j, d, 'component' AS kind, CASE WHEN nb = 'O' THEN 2 ELSE 1 END AS ord FROM p WHERE ca = cb AND ra = rb AND (na, nb) IN (('N', 'CA'), ('CA', 'C'), ('C', 'O'))),
k AS (SELECT s, least(i, j) AS i, greatest(i, j) AS j, d, 'conn' AS kind, 1 AS ord FROM p WHERE d < 2.4 AND ((ca = 0 AND ra = 1 AND na = 'CA' AND cb = 3 AND rb = 1 AND nb = 'O') OR (ca = 1 AND ra = 2 AND na = 'N' AND cb = 1 AND rb = 1 AND nb = 'CA'))),
l AS (SELECT s, i, j, d, 'polymer' AS kind, 1 AS ord FROM p WHERE ca = cb AND ca < 3 AND rb = ra + 1 AND na = 'C' AND nb = 'N' AND NOT (ca = 1 AND ra = 1 AND s IN (SELECT s FROM k WHERE j BETWEEN 16 AND 31))),
u AS (SELECT * FROM w UNION ALL SELECT * FROM k UNION ALL SELECT * FROM l)
SELECT s::VARCHAR AS structure, i, j, round(d, 5) AS d, kind, ord AS "order" FROM u"""
)
def structure_bonds(spark, sf_dir):
    """Bonds of the second model, whose sites are numbered from 65."""
    atoms, found = bonds.structure_bonds(mmcif.tables(spark, cif_files(spark, sf_dir), glob="*.txt", by_block=True), model=-1)
    for end in ("i", "j"):
        site = atoms.select("pdb_id", F.col("atom_idx").alias(end), (F.col("site_id") - 65).alias(f"_{end}"))
        found = found.join(site, ["pdb_id", end]).drop(end).withColumnRenamed(f"_{end}", end)
    return found.select(F.regexp_extract("pdb_id", "#([^#]*)$", 1).alias("structure"), "i", "j", F.round("d", 5).alias("d"), "kind", "order")


@query(
    "WITH "
    + _SITES.strip()
    + """, k AS (SELECT a.s FROM v_sites a JOIN v_sites b ON a.s = b.s WHERE a.c = 1 AND a.r = 2 AND a.a = 'N' AND b.c = 1 AND b.r = 1 AND b.a = 'CA' AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 2.4)
SELECT s::VARCHAR AS structure, e::VARCHAR AS entity_id, r, a AS atom_name FROM (SELECT DISTINCT s FROM v_sites) CROSS JOIN (SELECT unnest([1, 2, 3]) AS e) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS r) CROSS JOIN (SELECT unnest(['N', 'CA', 'C', 'O', 'OXT']) AS a)
WHERE a <> 'OXT' OR r = 4 OR (e = 2 AND r = 1 AND s IN (SELECT s FROM k))"""
)
def reference_atoms(spark, sf_dir):
    """Reference chains of the files above: a C that is linked loses OXT, but not where a connection takes the link's place."""
    atoms, found = bonds.structure_bonds(mmcif.tables(spark, cif_files(spark, sf_dir), glob="*.txt", by_block=True), model=1)
    structures = atoms.select("pdb_id").distinct()
    residues = structures.select("pdb_id", F.explode(F.array(*[F.lit(str(e)) for e in (1, 2, 3)])).alias("entity_id")).withColumn("res_id", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("res_name", F.lit("ALA"))
    names = [*_NAMES, "OXT"]
    comp_atoms = spark.createDataFrame([("ALA", i, a, a == "OXT") for i, a in enumerate(names)], "res_name string, pos long, atom_name string, leaving boolean")
    comp_bonds = spark.createDataFrame([("ALA", a, b) for a, b in (("N", "CA"), ("CA", "C"), ("C", "O"), ("C", "OXT"))], "res_name string, a string, b string")
    types = spark.createDataFrame([("ALA", "protein")], "res_name string, type string")
    kept, _ = reference_chains.reference_chains(residues, comp_atoms, comp_bonds, types, atoms, found)
    return kept.select(F.regexp_extract("pdb_id", "#([^#]*)$", 1).alias("structure"), "entity_id", F.col("res_id").alias("r"), "atom_name")
