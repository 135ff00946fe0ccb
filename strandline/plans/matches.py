"""Named queries over complexes of bounded size: matching of chains and pockets, sampled constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import constraints, matching
from strandline.plans.catalogue import query, r6
from strandline.plans.parts import draw_sql
from strandline.plans.views import table


def complexes(spark, sf_dir):
    """Four chains of sixteen tokens, two copies each of entities 0 and 1, for every 64 vectors: true tokens, and tokens that are
    predicted after a turn, a shift, a swap of copies (of entity 0 in odd structures, of entity 1 in every third) and noise in entity 1."""
    e, v = F.col("embedding"), F.col("vec_id")
    at = lambda i: e[i].cast("double") * 25
    tokens = table(spark, sf_dir, "embeddings").select(
        F.floor(v / 64).alias("pdb_id"), (v % 2).alias("entity_id"), (v % 4).alias("chain_id"), F.floor(v % 64 / 4).alias("token"), (v % 7 != 0).alias("is_resolved"),
        at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), *[e[3 + i].cast("double").alias(f"n{c}") for i, c in enumerate("xyz")],
    )
    swapped = F.when(F.col("entity_id") == 0, F.col("pdb_id") % 2 == 1).otherwise(F.col("pdb_id") % 3 == 0)
    source = tokens.select("pdb_id", F.when(swapped, (F.col("chain_id") + 2) % 4).otherwise(F.col("chain_id")).alias("chain_id"), "token", "x", "y", "z")
    noise = tokens.select("pdb_id", "entity_id", "chain_id", "token", *[f"n{c}" for c in "xyz"])
    n = lambda c: F.when(F.col("entity_id") == 1, F.col(f"n{c}")).otherwise(0.0)
    predicted = noise.join(source, ["pdb_id", "chain_id", "token"]).select(
        "pdb_id", "entity_id", "chain_id", "token", F.lit(False).alias("is_ligand"), (7 - F.col("y") + n("x")).alias("x"), (F.col("x") - 3 + n("y")).alias("y"), (F.col("z") + 1 + n("z")).alias("z")
    )
    return predicted, tokens.drop("nx", "ny", "nz")


#: By the way that the complexes are made: the true chain of each, and what noise leaves of it once the rest is laid exactly.
_PLANTED = """
v_tokens AS (SELECT vec_id // 64 AS pdb_id, vec_id % 2 AS entity_id, vec_id % 4 AS chain_id, vec_id % 64 // 4 AS token, vec_id % 7 <> 0 AS is_resolved,
  CASE WHEN vec_id % 2 = 1 THEN embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 ELSE 0 END AS noise FROM embeddings),
v_swaps AS (SELECT *, CASE WHEN CASE entity_id WHEN 0 THEN pdb_id % 2 = 1 ELSE pdb_id % 3 = 0 END THEN (chain_id + 2) % 4 ELSE chain_id END AS true_chain FROM v_tokens),
v_fits AS (SELECT s.pdb_id, s.entity_id, s.chain_id, s.true_chain, sqrt(avg(s.noise)) AS rmsd FROM v_swaps s JOIN v_tokens t ON s.pdb_id = t.pdb_id AND s.true_chain = t.chain_id AND s.token = t.token AND t.is_resolved GROUP BY ALL)"""


@query(
    "WITH "
    + _PLANTED.strip()
    + """, a AS (SELECT pdb_id, true_chain AS anchor_true FROM v_fits WHERE chain_id = 0)
SELECT pdb_id, chain_id::VARCHAR AS chain_id, true_chain::VARCHAR AS true_chain, '0' AS anchor, anchor_true::VARCHAR AS anchor_true, round(rmsd, 5) + 0.0::DOUBLE AS rmsd, round(avg(rmsd) OVER (PARTITION BY pdb_id), 5) AS total FROM v_fits JOIN a USING (pdb_id)"""
)
def anchor_chain_match(spark, sf_dir):
    """Chains are found by the search; the SQL knows them from how the complexes are made."""
    predicted, true = complexes(spark, sf_dir)
    out = matching.match_by_anchor(predicted, true)
    return out.select("pdb_id", "chain_id", "true_chain", "anchor", "anchor_true", F.round("rmsd", 5).alias("rmsd"), F.round("total", 5).alias("total"))


@query(
    "WITH "
    + _PLANTED.strip()
    + """, s AS (SELECT unnest([1, 2])::INT AS sample)
SELECT pdb_id, sample, p.chain_id AS pocket_chain, l.chain_id AS ligand_chain, round(l.rmsd * sample, 5) AS rmsd, p.chain_id <> 0 AS permuted_pocket, l.chain_id <> 1 AS permuted_ligand,
 CASE WHEN p.chain_id <> 0 OR l.chain_id <> 1 THEN 'better' ELSE 'equal' END AS outcome FROM v_fits p JOIN v_fits l USING (pdb_id) CROSS JOIN s WHERE p.true_chain = 0 AND l.true_chain = 1"""
)
def pocket_match(spark, sf_dir):
    """Entity 0 holds the pocket, its first eight tokens; chain 1 is the ligand. The second sample has twice the noise."""
    predicted, true = complexes(spark, sf_dir)
    e = F.col("embedding")
    again = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 64).alias("pdb_id"), (F.col("vec_id") % 4).alias("chain_id"), F.floor(F.col("vec_id") % 64 / 4).alias("token"), *[e[3 + i].cast("double").alias(f"n{c}") for i, c in enumerate("xyz")])
    noisy = predicted.join(again, ["pdb_id", "chain_id", "token"], "left").select("pdb_id", "entity_id", "chain_id", "token", *[(F.col(c) + F.coalesce(f"n{c}", F.lit(0.0))).alias(c) for c in "xyz"])
    samples = predicted.drop("is_ligand").withColumn("sample", F.lit(1)).unionByName(noisy.withColumn("sample", F.lit(2)))
    true = true.withColumn("is_pocket", (F.col("chain_id") == 0) & (F.col("token") < 8)).withColumn("is_ligand", F.col("chain_id") == 1)
    out = matching.match_pockets(samples, true)
    return out.select("pdb_id", "sample", "pocket_chain", "ligand_chain", F.round("rmsd", 5).alias("rmsd"), "permuted_pocket", "permuted_ligand", "outcome")


# --- sampled constraints ---

_TOKENS = """
v_ct AS (SELECT vec_id // 64 AS pdb_id, vec_id % 64 AS token, vec_id % 4 AS chain_id, CASE WHEN vec_id % 4 = 3 THEN 'L' ELSE 'P' END AS kind, vec_id % 7 <> 0 AS is_resolved,
  embedding[1]::DOUBLE * 25 AS x, embedding[2]::DOUBLE * 25 AS y, embedding[3]::DOUBLE * 25 AS z FROM embeddings),
v_near AS (SELECT a.pdb_id, a.token AS i, b.token AS j, a.chain_id AS ci, b.chain_id AS cj, a.kind AS ki, b.kind AS kj, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM v_ct a JOIN v_ct b ON a.pdb_id = b.pdb_id AND a.token <> b.token AND a.is_resolved AND b.is_resolved)"""


def constraint_tokens(spark, sf_dir):
    """Sixty-four tokens in four chains for every 64 vectors; chain 3 is a ligand."""
    e, v = F.col("embedding"), F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 64).alias("pdb_id"), (v % 64).alias("token"), (v % 4).alias("chain_id"), F.when(v % 4 == 3, "L").otherwise("P").alias("kind"), (v % 7 != 0).alias("is_resolved"),
        *[(e[i].cast("double") * 25).alias(c) for i, c in enumerate("xyz")],
    )


def _range_sql(purpose: str, kind: str, low: float, high: float) -> str:
    return f"({low}::DOUBLE + {draw_sql('pdb_id', f'3:{purpose}:{kind}')} * {high - low}::DOUBLE)"


def _contact_type_sql(kind: str, low: float, high: float) -> str:
    one, two = kind
    most = _range_sql("contact", kind, low, high)
    place = "ci = cj AND j - i >= 20" if two == "_" else f"ci <> cj AND ((ki = '{one}' AND kj = '{two}') OR (ki = '{two}' AND kj = '{one}'))"
    return f"CASE WHEN {place} AND d <= {most} THEN {most} END"


_CONTACTS = {"PP": (3.0, 6.0), "PL": (2.0, 5.0), "LP": (2.0, 7.0), "P_": (4.0, 8.0)}
_POCKETS = {"PP": (2.0, 5.0), "LP": (3.0, 6.0)}


@query(
    "WITH "
    + _TOKENS.strip()
    + f""", f AS (SELECT *, least(ci, cj) AS c1, greatest(ci, cj) AS c2, coalesce({', '.join(_contact_type_sql(k, *r) for k, r in reversed(_CONTACTS.items()))}) AS most FROM v_near WHERE i < j),
k AS (SELECT *, row_number() OVER (PARTITION BY pdb_id, c1, c2 ORDER BY {draw_sql("(pdb_id || ':' || i || ':' || j)", '3:contact:pair')}, i, j) AS nth, floor(ln({draw_sql("(pdb_id || ':' || c1 || ':' || c2)", '3:contact:size')}) / ln(0.6::DOUBLE)) + 1 AS size FROM f WHERE most IS NOT NULL AND c1 <> c2),
p AS (SELECT pdb_id, i, j, most FROM k WHERE nth <= size)
SELECT pdb_id, i, j, round(most, 6) AS most FROM p UNION ALL SELECT pdb_id, j, i, round(most, 6) FROM p"""
)
def sampled_contacts(spark, sf_dir):
    """A geometric number of contacts for each pair of chains."""
    out = constraints.contacts(constraint_tokens(spark, sf_dir), _CONTACTS, 0.4, 3, group="interface")
    return out.select("pdb_id", "i", "j", r6("most"))


@query(
    "WITH "
    + _TOKENS.strip()
    + f""", n AS (SELECT pdb_id, ci AS binder, j AS token, max(CASE WHEN ki = 'P' AND kj = 'P' AND d <= {_range_sql('pocket', 'PP', *_POCKETS['PP'])} THEN {_range_sql('pocket', 'PP', *_POCKETS['PP'])} END) AS pp,
 max(CASE WHEN ki = 'L' AND kj = 'P' AND d <= {_range_sql('pocket', 'LP', *_POCKETS['LP'])} THEN {_range_sql('pocket', 'LP', *_POCKETS['LP'])} END) AS lp FROM v_near WHERE ci <> cj GROUP BY ALL),
f AS (SELECT pdb_id, binder, token, coalesce(lp, pp) AS most FROM n WHERE coalesce(lp, pp) IS NOT NULL),
b AS (SELECT DISTINCT ON (pdb_id) pdb_id, binder FROM f ORDER BY pdb_id, {draw_sql("(pdb_id || ':' || binder)", '3:pocket:binder')}, binder)
SELECT pdb_id, binder, token, round(most, 6) AS most FROM f SEMI JOIN b USING (pdb_id, binder) QUALIFY row_number() OVER (PARTITION BY pdb_id ORDER BY {draw_sql("(pdb_id || ':' || token)", '3:pocket:token')}, token) <= 5"""
)
def sampled_pocket(spark, sf_dir):
    return constraints.pockets(constraint_tokens(spark, sf_dir), _POCKETS, 5, 3).select("pdb_id", "binder", "token", r6("most"))


@query(
    "WITH "
    + _TOKENS.strip()
    + f""", t AS (SELECT DISTINCT pdb_id, ci AS chain_id, ki || ':' || kj AS kinds FROM v_near WHERE ci <> cj AND ((ki = 'P' AND kj = 'P' AND d <= 3) OR (ki = 'P' AND kj = 'L' AND d <= 4))),
r AS (SELECT *, row_number() OVER (PARTITION BY pdb_id ORDER BY {draw_sql("(pdb_id || ':' || chain_id || ':' || kinds)", '3:substructure:chain')}, chain_id, kinds) AS nth, count(*) OVER (PARTITION BY pdb_id) AS valid,
 least(floor(2 * ([0.0, 0.5, 1.0])[floor({draw_sql('pdb_id', '3:substructure:full')} * 3)::INT + 1]), count(*) OVER (PARTITION BY pdb_id)) AS whole FROM t),
c AS (SELECT pdb_id, chain_id, count(*) AS n FROM v_ct WHERE is_resolved GROUP BY ALL),
k AS (SELECT pdb_id, chain_id, min(CASE WHEN nth <= whole THEN 'full' ELSE 'partial' END) AS part, max(CASE WHEN nth <= whole THEN n ELSE greatest(1, floor(n * {draw_sql("(pdb_id || ':' || chain_id || ':' || kinds)", '3:substructure:share')})) END) AS k
 FROM r JOIN c USING (pdb_id, chain_id) WHERE nth <= whole + least(2 - whole, valid - whole) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY pdb_id, chain_id ORDER BY {draw_sql("(pdb_id || ':' || chain_id || ':' || token)", '3:substructure:token')}, token) AS nth FROM v_ct WHERE is_resolved)
SELECT pdb_id, chain_id, token, part FROM o JOIN k USING (pdb_id, chain_id) WHERE nth <= k"""
)
def sampled_substructure(spark, sf_dir):
    return constraints.substructures(constraint_tokens(spark, sf_dir), [("P", "P", 3.0), ("P", "L", 4.0)], 2, 3)
