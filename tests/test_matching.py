"""Matching of chains and pockets against plain Python, and all assignments where they are few."""

import itertools

import numpy as np
import pytest

from strandline.operators import matching


def turn(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def fit(s, t):
    """Rotation and shift of s onto t, by its own way: the quaternion of the largest eigenvalue."""
    a, b = s - s.mean(0), t - t.mean(0)
    m = a.T @ b
    k = np.array([
        [m[0, 0] + m[1, 1] + m[2, 2], m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]],
        [m[1, 2] - m[2, 1], m[0, 0] - m[1, 1] - m[2, 2], m[0, 1] + m[1, 0], m[2, 0] + m[0, 2]],
        [m[2, 0] - m[0, 2], m[0, 1] + m[1, 0], m[1, 1] - m[0, 0] - m[2, 2], m[1, 2] + m[2, 1]],
        [m[0, 1] - m[1, 0], m[2, 0] + m[0, 2], m[1, 2] + m[2, 1], m[2, 2] - m[0, 0] - m[1, 1]],
    ])
    w, x, y, z = np.linalg.eigh(k)[1][:, -1]
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return r, t.mean(0) - r @ s.mean(0)


def complex_of(rng, lengths, swap, noise=0.05, missing=0.1):
    """Chains {id: (entity, points)}; predicted chain c lies where true chain swap[c] does."""
    true = {c: (e, rng.normal(size=(n, 3)) * 8 + rng.normal(size=3) * 10) for c, (e, n) in lengths.items()}
    r, t = turn(rng), rng.normal(size=3) * 20
    predicted = {c: (e, true[swap[c]][1] @ r.T + t + rng.normal(size=(n, 3)) * noise) for c, (e, n) in lengths.items()}
    resolved = {c: rng.random(len(p)) > missing for c, (_, p) in true.items()}
    return predicted, true, resolved


def frames(spark, complexes, ligands=()):
    p = [(k, e, c, i, c in ligands, *map(float, x)) for k, (pred, _, _) in enumerate(complexes) for c, (e, pts) in pred.items() for i, x in enumerate(pts)]
    t = [(k, e, c, i, bool(res[c][i]), *map(float, x)) for k, (_, true, res) in enumerate(complexes) for c, (e, pts) in true.items() for i, x in enumerate(pts)]
    return spark.createDataFrame(p, "pdb_id long, entity_id long, chain_id string, token long, is_ligand boolean, x double, y double, z double"), spark.createDataFrame(t, "pdb_id long, entity_id long, chain_id string, token long, is_resolved boolean, x double, y double, z double")


def searched(predicted, true, resolved):
    """The search as it is described, chain by chain."""
    copies = lambda e: sorted(c for c in true if true[c][0] == e)
    able = [c for c in predicted if len(predicted[c][1]) >= 4 and any(resolved[d].sum() >= 4 for d in copies(predicted[c][0]))]
    size = {e: sum(len(p) for k, p in predicted.values() if k == e) for e in {k for k, _ in predicted.values()}}
    anchor = min(able, key=lambda c: (size[predicted[c][0]] < 12, len(copies(predicted[c][0])), -len(predicted[c][1]), c))
    best = None
    for g in copies(predicted[anchor][0]):
        mask = resolved[g]
        if not mask.any():
            continue
        r, t = fit(true[g][1][mask], predicted[anchor][1][mask])
        moved = {c: p @ r.T + t for c, (_, p) in true.items()}
        match, left = {anchor: g}, set(true) - {g}
        for c in sorted(set(predicted) - {anchor}, key=lambda c: (-len(predicted[c][1]), c)):
            options = [d for d in copies(predicted[c][0]) if d in left]
            d = min((d for d in options if resolved[d].any()), key=lambda d: np.linalg.norm(moved[d][resolved[d]].mean(0) - predicted[c][1][resolved[d]].mean(0)), default=options[0])
            match[c] = d
            left.remove(d)
        rmsd = {c: np.sqrt((((moved[d] - predicted[c][1])[resolved[d]]) ** 2).sum(1).mean()) if resolved[d].any() else 0.0 for c, d in match.items()}
        total = np.mean(list(rmsd.values()))
        if best is None or total < best[0] - 1e-12:
            best = (total, g, match, rmsd)
    return anchor, best


def test_anchor_search(spark):
    rng = np.random.default_rng(4)
    lengths = {"A": (0, 16), "B": (1, 9), "C": (0, 16), "D": (1, 9), "E": (2, 5)}
    swaps = [dict(zip("ABCDE", s)) for s in ("ABCDE", "CBADE", "ADCBE", "CDABE")]
    complexes = [complex_of(rng, lengths, s, noise) for s in swaps for noise in (0.05, 4.0)]
    complexes[3][2]["B"][:] = False  # an unresolved copy is taken last
    rows = matching.match_by_anchor(*frames(spark, complexes)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["pdb_id"], {})[r["chain_id"]] = r
    for k, one in enumerate(complexes):
        anchor, (total, g, match, rmsd) = searched(*one)
        assert {c: r["true_chain"] for c, r in got[k].items()} == match
        assert all(r["anchor"] == anchor and r["anchor_true"] == g and r["total"] == pytest.approx(total, abs=1e-6) for r in got[k].values())
        assert all(r["rmsd"] is None or r["rmsd"] == pytest.approx(rmsd[c], abs=1e-6) for c, r in got[k].items())
    # Where chains lie rigidly, the search finds what the best of all assignments is.
    for k in range(0, len(complexes), 2):
        predicted, true, resolved = complexes[k]
        entities = [[c for c in true if true[c][0] == e] for e in (0, 1, 2)]
        costs = {}
        for perms in itertools.product(*[list(itertools.permutations(e)) for e in entities]):
            match = {c: d for e, p in zip(entities, perms) for c, d in zip(e, p)}
            s = np.concatenate([true[d][1][resolved[d]] for d in match.values()])
            t = np.concatenate([predicted[c][1][resolved[d]] for c, d in match.items()])
            r, shift = fit(s, t)
            costs[tuple(match[c] for c in "ABCDE")] = ((s @ r.T + shift - t) ** 2).sum()
        assert tuple(got[k][c]["true_chain"] for c in "ABCDE") == min(costs, key=costs.get)


def test_anchor_choice(spark):
    rng = np.random.default_rng(5)
    cases = [
        ({"A": (0, 20), "B": (0, 20), "C": (1, 12)}, (), "C"),  # fewest copies
        ({"A": (0, 20), "C": (1, 11)}, (), "A"),  # a small entity is no polymer
        ({"A": (0, 20), "C": (1, 30)}, ("C",), "A"),  # nor is a ligand
        ({"A": (0, 3), "C": (1, 5)}, ("C",), "C"),  # too few tokens
        ({"A": (0, 14), "B": (1, 15)}, (), "B"),  # the longest
    ]
    for lengths, ligands, expected in cases:
        one = complex_of(rng, lengths, {c: c for c in lengths}, missing=0)
        predicted, true = frames(spark, [one], ligands)
        assert [r["chain_id"] for r in matching.anchor_chains(predicted, true).collect()] == [expected]
    one = complex_of(rng, {"A": (0, 3)}, {"A": "A"})
    assert matching.match_by_anchor(*frames(spark, [one])).count() == 0


def test_more_predicted_than_true(spark):
    rng = np.random.default_rng(6)
    predicted, true, resolved = complex_of(rng, {"A": (0, 16), "B": (0, 16)}, {"A": "A", "B": "B"}, missing=0)
    p, t = frames(spark, [(predicted, true, resolved)])
    rows = {r["chain_id"]: r["true_chain"] for r in matching.match_by_anchor(p, t.where("chain_id = 'A'")).collect()}
    assert rows == {"A": "A", "B": None}


def test_pocket_search(spark):
    rng = np.random.default_rng(7)
    lengths = {"A": (0, 16), "B": (1, 6), "C": (0, 16), "D": (1, 6)}
    complexes = [complex_of(rng, lengths, dict(zip("ABCD", s)), noise, 0.2) for s in ("ABCD", "CBAD", "CDAB") for noise in (0.1, 5.0)]
    predicted, true = frames(spark, complexes)
    from pyspark.sql import functions as F

    true = true.withColumn("is_pocket", F.expr("chain_id = 'A' AND token < 9")).withColumn("is_ligand", F.expr("chain_id = 'B'"))
    rows = {r["pdb_id"]: r for r in matching.match_pockets(predicted.withColumn("sample", F.lit(0)).drop("is_ligand"), true).collect()}
    for k, (pred, tru, res) in enumerate(complexes):
        pm, lm = res["A"][:9], res["B"]
        tried = {}
        for i, j in itertools.product("AC", "BD"):
            r, t = fit(pred[i][1][:9][pm], tru["A"][1][:9][pm])
            tried[i, j] = np.sqrt((((pred[j][1] @ r.T + t - tru["B"][1])[lm]) ** 2).sum(1).mean())
        best = min(tried, key=lambda x: (round(tried[x], 9), x))
        row = rows[k]
        assert (row["pocket_chain"], row["ligand_chain"]) == best
        assert row["rmsd"] == pytest.approx(tried[best], abs=1e-6) and row["unpermuted_rmsd"] == pytest.approx(tried["A", "B"], abs=1e-6)
        assert (row["permuted_pocket"], row["permuted_ligand"]) == (best[0] != "A", best[1] != "B")
        assert row["outcome"] == ("equal" if best == ("A", "B") else "better")
