"""Named queries: entities of PDB text, whole template processing, frames, and streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import pdb_entities, structure
from strandline.operators.template_process import process
from strandline.plans import views
from strandline.plans.catalogue import query
from strandline.plans.views import ATOMS, table
from strandline.streaming import leases

_PDB = """
l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey AS p FROM lineitem),
r AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY n, p) AS pos, CASE WHEN n <= 3 THEN 'A' ELSE 'B' END AS c, p % 7 = 0 AS het, CASE k % 3 WHEN 0 THEN ['DA', 'DT'][p % 2 + 1] WHEN 1 THEN ['ALA', 'GLY', 'UNK'][p % 3 + 1] ELSE ['A', 'DA', 'SER', 'HEM'][p % 4 + 1] END AS name FROM l),
g AS (SELECT *, pos * (1 + (k % 2 = 0)::INT) AS res, lag(c) OVER w AS lc, lag(het) OVER w AS lh, bool_or(het) OVER (PARTITION BY k, c) AS any_het, lead(c) OVER w AS nc FROM r WINDOW w AS (PARTITION BY k ORDER BY pos)),
s AS (SELECT *, sum(CASE WHEN lc IS DISTINCT FROM c OR lh <> het OR (het AND lh) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS segment FROM g),
m AS (SELECT k, c, count(DISTINCT name) FILTER (name IN ('DA', 'DT')) AS d, count(DISTINCT name) FILTER (name IN ('ALA', 'GLY', 'UNK', 'SER')) AS p, count(DISTINCT name) FILTER (name = 'A') AS r FROM r GROUP BY k, c),
f AS (SELECT s.*, CASE WHEN m.d > 0 AND m.d >= m.p AND m.d >= m.r THEN 'DN' WHEN m.r > 0 AND m.r >= m.p AND m.r >= m.d THEN 'N' ELSE 'UNK' END AS miss FROM s JOIN m USING (k, c)),
e AS (SELECT k, segment, flatten(list(CASE WHEN k % 2 = 0 AND NOT any_het AND nc = c THEN [name, miss] ELSE [name] END ORDER BY pos)) AS names FROM f GROUP BY k, segment),
t AS (SELECT *, list_reverse(names) AS back, len(list_filter(names, lambda x: x NOT IN ('DA', 'DT', 'DN'))) = 0 AS dna FROM e),
q AS (SELECT *, row_number() OVER v AS nth, first_value(names) OVER v AS fst FROM t WINDOW v AS (PARTITION BY k, CASE WHEN dna THEN least(names, back) ELSE names END ORDER BY segment)),
u AS (SELECT k, segment, dna AND (nth >= 3 OR (nth = 2 AND names = fst)) AS turned, CASE WHEN dna AND (nth >= 3 OR (nth = 2 AND names = fst)) THEN back ELSE names END AS names FROM q),
o AS (SELECT *, min(segment) OVER (PARTITION BY k, names) AS frm FROM u),
z AS (SELECT *, len(list_filter(names, lambda x: x IN ('ALA', 'GLY', 'UNK', 'SER'))) AS np, len(list_filter(names, lambda x: x IN ('DA', 'DT', 'DN'))) AS nd, len(list_filter(names, lambda x: x IN ('A', 'N'))) AS nr FROM o)"""


@query(
    "WITH "
    + _PDB.strip()
    + """ SELECT k AS pdb_id, chr(64 + segment::INT) AS asym_id, dense_rank() OVER (PARTITION BY k ORDER BY frm) AS entity_id, turned, array_to_string(names, '_') AS names,
  CASE WHEN np >= 2 AND nd + nr = 0 THEN 'polypeptide(L)' WHEN nd >= 2 AND np + nr = 0 THEN 'polydeoxyribonucleotide' WHEN nr >= 2 AND np + nd = 0 THEN 'polyribonucleotide' END AS poly_type FROM z"""
)
def pdb_text_entities(spark, sf_dir):
    """Orders written as PDB text, a residue for each item, in two models; chains, entities and polymer types are inferred."""
    k, p = F.col("k"), F.col("p")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    orders = pdb_entities.by_file(items, 2 * items.count(), "k").groupBy("k").agg(F.sort_array(F.collect_set(F.struct("n", "p"))).alias("l"))
    listed = orders.select("k", F.posexplode("l").alias("i", "l")).select("k", (F.col("i") + 1).alias("pos"), "l.n", "l.p")
    name = F.when(k % 3 == 0, pick(("DA", "DT"), p % 2)).when(k % 3 == 1, pick(("ALA", "GLY", "UNK"), p % 3)).otherwise(pick(("A", "DA", "SER", "HEM"), p % 4))
    line = F.format_string("%-6s%5d  CA  %3s %1s%4d    %8.3f%8.3f%8.3f%6.2f%6.2f           C", F.when(p % 7 == 0, "HETATM").otherwise("ATOM"), "pos", name, F.when(F.col("n") <= 3, "A").otherwise("B"), F.col("pos") * F.when(k % 2 == 0, 2).otherwise(1), *[F.lit(0.0)] * 3, F.lit(1.0), F.lit(0.0))
    first = listed.select(k.alias("pdb_id"), "pos", line.alias("line"))
    row = lambda pos, text: F.struct(pos.alias("pos"), text.alias("line"))
    model = F.lit("MODEL        1")
    twice = [row(F.col("pos"), F.col("line")), row(F.col("pos") + 1000, F.col("line"))]
    headed = F.when(F.col("pos") == 1, F.array(row(F.lit(0), model), row(F.lit(1000), model), *twice)).otherwise(F.array(*twice))
    lines = first.select("pdb_id", F.inline(headed))
    _, made = pdb_entities.inferred(lines)
    return made.select("pdb_id", "asym_id", "entity_id", "turned", F.array_join("names", "_").alias("names"), "poly_type")


# --- templates ---

_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
_TEMPLATES = f"""
v_t AS (SELECT vec_id // 32 AS k, CASE WHEN vec_id // 32 % 3 = 0 AND vec_id % 32 >= 16 THEN 'B' ELSE 'A' END AS c, CASE WHEN vec_id // 32 % 3 = 0 THEN vec_id % 16 // 4 ELSE vec_id % 32 // 4 END AS place, ['N', 'CA', 'C', 'CB'][vec_id % 4 + 1] AS a,
  embedding[1]::DOUBLE * 25 AS x, embedding[2]::DOUBLE * 25 AS y, embedding[3]::DOUBLE * 25 AS z, vec_id % 7 <> 0 AND vec_id // 32 % 11 <> 5 AS seen FROM embeddings),
v_c AS (SELECT k, c, max(place) + 1 AS len, k % 5 AS off, substr('{_ALPHABET}', (k % 5 + 1)::INT, (max(place) + 1)::INT) AS seq FROM v_t WHERE k % 13 <> 4 GROUP BY k, c),
v_k AS (SELECT k, CASE WHEN k % 4 <> 3 THEN DATE '1995-01-01' + (k * 100)::INT END AS released, (SELECT count(*) FROM v_c WHERE v_c.k = s.k) AS n FROM (SELECT DISTINCT k FROM v_t) s),
v_m AS (SELECT k, c, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM v_t WHERE seen GROUP BY k, c),
v_b AS (SELECT DISTINCT k, c FROM (SELECT k, c, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2 + (lead(z) OVER w - z) ** 2) AS d FROM v_t WHERE seen AND a = 'CA' WINDOW w AS (PARTITION BY k, c ORDER BY place)) WHERE d > 9),
v_h AS (SELECT o_orderkey AS hit, o_custkey % 4 AS q, CASE WHEN o_orderkey % 19 >= 17 THEN o_orderkey % 19 - 17 ELSE o_orderkey % 19 END AS k, ['A', 'B', 'C'][o_custkey % 3 + 1] AS asked, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS p FROM orders),
v_u AS (SELECT h.*, v_k.released, v_k.n, CASE WHEN own.c IS NOT NULL THEN own.c WHEN v_k.n = 1 THEN one.c END AS c, v_k.k IS NOT NULL AS there FROM v_h h LEFT JOIN v_k USING (k) LEFT JOIN v_c own ON own.k = h.k AND own.c = asked LEFT JOIN v_c one ON one.k = h.k AND v_k.n = 1),
v_n AS (SELECT k, c, count(*) AS atoms, sum((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) AS spread FROM v_t JOIN v_m USING (k, c) WHERE seen GROUP BY k, c),
v_e AS (SELECT u.*, v_c.len, v_c.off, v_c.seq, v_n.atoms, v_n.spread, CASE WHEN NOT there THEN 'load' WHEN n = 0 THEN 'parse' WHEN coalesce(released, DATE '9999-12-31') > DATE '1998-06-01' THEN 'date' WHEN u.c IS NULL THEN 'chain' WHEN q = 3 THEN 'align' WHEN v_b.k IS NOT NULL THEN 'distance' WHEN coalesce(v_n.atoms, 0) < 12 THEN 'atoms' END AS error
  FROM v_u u LEFT JOIN v_c ON v_c.k = u.k AND v_c.c = u.c LEFT JOIN v_b ON v_b.k = u.k AND v_b.c = u.c LEFT JOIN v_n ON v_n.k = u.k AND v_n.c = u.c)"""


@query(
    "WITH "
    + _TEMPLATES.strip()
    + """ SELECT 'q' || q AS query, hit, k AS pdb_id, CASE WHEN error IS NULL THEN c END AS chain_id, error, CASE WHEN error IS NULL THEN len::INT END AS aligned_cols, CASE WHEN error IS NULL THEN repeat('-', off::INT) || seq || repeat('-', (20 - off - len)::INT) END AS sequence,
  CASE WHEN error IS NULL THEN atoms END AS atoms, CASE WHEN error IS NULL THEN coalesce(p, 0) END AS sum_probs, CASE WHEN error IS NULL THEN round(spread, 3) END AS spread FROM v_e"""
)
def template_process(spark, sf_dir):
    """Orders as hits on structures of 32 vectors: loaded, dated, aligned and placed, each with its error. All letters of a query differ, so its alignment is known."""
    v, e = F.col("vec_id"), F.col("embedding")
    k = F.floor(v / 32)
    halves = k % 3 == 0
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    every = table(spark, sf_dir, "embeddings").select(
        k.alias("pdb_id"), F.when(halves & (v % 32 >= 16), "B").otherwise("A").alias("chain_id"), F.floor(F.when(halves, v % 16).otherwise(v % 32) / 4).cast("int").alias("place"), F.lit("ALA").alias("res_name"), pick(("N", "CA", "C", "CB"), v % 4).alias("atom_name"),
        *[(e[i].cast("double") * 25).alias(c) for i, c in enumerate("xyz")], ((v % 7 != 0) & (k % 11 != 5)).alias("_seen"),
    )
    p = F.col("pdb_id")
    structures = every.select(p).distinct().select(p, F.when(p % 4 != 3, F.date_add(F.lit("1995-01-01").cast("date"), (p * 100).cast("int"))).alias("release_date"))
    seqres = every.where(p % 13 != 4).select("pdb_id", "chain_id", "place").distinct().withColumn("letter", F.substring(F.lit(_ALPHABET), (p % 5 + F.col("place") + 1).cast("int"), F.lit(1)))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    hits = table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), c % 4).alias("query"), o.alias("hit"), F.when(c % 4 != 3, _ALPHABET).alias("query_seq"), (o % 19).alias("pdb_id"), pick("ABC", c % 3).alias("chain_id"), F.when(o % 5 != 0, F.col("o_totalprice")).alias("sum_probs"))
    obsolete = table(spark, sf_dir, "nation").where("n_nationkey IN (17, 18)").select(F.col("n_nationkey").alias("pdb_id"), (F.col("n_nationkey") - 17).alias("replaced_by"))
    results, features = process(hits, structures, seqres, every.where("_seen"), "1998-06-01", obsolete, strict=True, most_step=9.0, least_atoms=12)
    spread = features.select("query", "hit", F.explode("positions").alias("a")).groupBy("query", "hit").agg(F.round(F.sum(F.pow("a.x", 2) + F.pow("a.y", 2) + F.pow("a.z", 2)), 3).alias("spread"))
    return results.join(spread, ["query", "hit"], "left").select("query", "hit", "pdb_id", "chain_id", "error", "aligned_cols", "sequence", "atoms", "sum_probs", "spread")


# --- streams ---


@query("WITH e AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM events) SELECT user_id::VARCHAR AS key, event_id AS id, ts FROM e WHERE seen IS NULL OR ts - seen > INTERVAL 6 HOUR")
def leased_sightings(spark, sf_dir):
    """Events of users after a pause of more than six hours; `leases.leased_stream` gives the same rows of a stream."""
    return leases.leased_batch(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", 6 * 3600)


# --- order and frames ---


@query(
    "WITH "
    + ATOMS.strip()
    + """, a AS (SELECT pdb_id, atom_idx, atom_idx % 7 AS c, CASE WHEN atom_idx % 7 < 3 THEN '10' ELSE '9' END AS e FROM v_atoms WHERE atom_idx % 7 <> 2 OR res_id % 2 = 0),
c AS (SELECT pdb_id, c, min(e) AS e, count(*) AS n, min(atom_idx) AS f FROM a GROUP BY pdb_id, c), r AS (SELECT pdb_id, c, row_number() OVER (PARTITION BY pdb_id ORDER BY e, n DESC, f) AS k FROM c)
SELECT a.pdb_id, atom_idx, a.c AS chain_id, row_number() OVER (PARTITION BY a.pdb_id ORDER BY k, atom_idx) - 1 AS place FROM a JOIN r USING (pdb_id, c)"""
)
def entity_chain_order(spark, sf_dir):
    i = F.col("atom_idx")
    atoms = views.atoms(spark, sf_dir).where((i % 7 != 2) | (F.col("res_id") % 2 == 0)).select("pdb_id", "atom_idx", (i % 7).alias("chain_id"), F.when(i % 7 < 3, 10).otherwise(9).alias("entity_id"))
    return structure.chains_by_entity(atoms).select("pdb_id", "atom_idx", "chain_id", "place")


@query(
    "WITH "
    + ATOMS.strip()
    + """, t AS (SELECT res_id // 8 AS pdb_id, res_id AS token, [max(CASE WHEN atom_name = 'N' THEN atom_idx END), max(CASE WHEN atom_name = 'CA' THEN atom_idx END), max(CASE WHEN atom_name = 'C' THEN atom_idx END)] AS a FROM v_atoms WHERE is_resolved GROUP BY ALL)
SELECT pdb_id, token, (len(list_filter(a, lambda x: x IS NULL)) = 0)::INT AS has_frame, CASE WHEN len(list_filter(a, lambda x: x IS NULL)) = 0 THEN a ELSE [-1, -1, -1]::BIGINT[] END AS frame FROM t"""
)
def backbone_frames(spark, sf_dir):
    """Structures of eight residues; odd residues stand for nucleotides."""
    odd, name = F.col("res_id") % 2 == 1, F.col("atom_name")
    named = F.when(odd & (name == "N"), "C1'").when(odd & (name == "CA"), "C3'").when(odd & (name == "C"), "C4'").otherwise(name)
    atoms = views.atoms(spark, sf_dir).where("is_resolved").select(F.floor(F.col("res_id") / 8).alias("pdb_id"), F.col("res_id").alias("token"), F.when(odd, "rna").otherwise("protein").alias("mol_type"), named.alias("atom_name"), "atom_idx")
    return structure.polymer_frames(atoms)
