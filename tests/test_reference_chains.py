"""Reference chains and jobs from structures against rules in plain Python."""

import random
from collections import defaultdict

from strandline.operators import reference_chains as R

COMPONENTS = {  # atoms, those that leave, bonds
    "AAA": (["N", "CA", "C", "O", "OXT", "CB"], {"OXT"}, ["N-CA", "CA-C", "C-O", "C-OXT", "CA-CB"]),
    "SSS": (["N", "CA", "C", "O", "OXT", "SG", "H1", "H2", "H3"], {"OXT", "H1", "H2", "H3"}, ["N-CA", "CA-C", "C-O", "C-OXT", "CA-SG", "SG-H1", "SG-H2", "H2-H3"]),
    "MMM": (["N", "CA", "C", "O", "OXT", "L"], {"OXT", "L"}, ["N-CA", "CA-C", "C-O", "C-OXT", "N-L", "CA-L"]),  # a group on two centres
    "NNN": (["O3'", "P", "OP1", "OP3", "HO"], {"OP3", "HO"}, ["P-OP1", "P-OP3", "O3'-HO", "P-O3'"]),
}
TYPES = {"AAA": "protein", "SSS": "protein", "MMM": "protein", "NNN": "nucleic"}


def plain(sequence, observed, bonds):
    """sequence: residues of the entity; observed: {idx: (chain, res, name)}; bonds: set of pairs."""
    near = defaultdict(set)
    for i, j in bonds:
        near[i].add(j)
        near[j].add(i)
    where = defaultdict(list)
    for i, (c, r, n) in observed.items():
        where[r, n].append(i)
    count, links = defaultdict(int), set()
    for r, (a, b) in enumerate(zip(sequence, sequence[1:]), 1):
        if TYPES[a] != TYPES[b]:
            continue
        x, y = ("C", "N") if TYPES[a] == "protein" else ("O3'", "P")
        if any(observed[i][0] == observed[j][0] and j not in near[i] for i in where[r, x] for j in where[r + 1, y]):
            continue
        links.add((r, x, y))
        count[(r, "C") if x == "C" else (r + 1, "P")] = 1
    for i, (c, r, n) in observed.items():
        k = sum(observed[j][:2] != (c, r) for j in near[i])
        count[r, n] = max(count[r, n], k)
    out = set()
    for r, name in enumerate(sequence, 1):
        atoms, leaving, pairs = COMPONENTS[name]
        adjacent = defaultdict(set)
        for p in pairs:
            a, b = p.split("-")
            adjacent[a].add(b)
            adjacent[b].add(a)
        groups, bad, seen = defaultdict(list), False, set()
        for a in atoms:
            if a in leaving and a not in seen:
                group, todo = {a}, [a]
                while todo:
                    for b in adjacent[todo.pop()] & leaving - group:
                        group.add(b)
                        todo.append(b)
                seen |= group
                centres = [b for x in group for b in adjacent[x] - leaving]
                bad |= len(centres) > 1
                if centres:
                    groups[centres[0]].append(group)
        gone = set()
        for a in atoms:
            k = count[r, a]
            if not k or bad:
                continue
            if a in groups:
                own = sorted(groups[a], key=lambda g: (any(where[r, x] for x in g), min(atoms.index(x) for x in g)))
                for g in own[:k]:
                    gone |= g
            else:
                lacks = [[b for b in atoms if b in adjacent[a] and len(adjacent[b]) == 1 and b not in {observed[j][2] for j in near[i]}] for i in sorted(where[r, a])]
                if lacks:
                    gone |= set(max(lacks, key=len))
        out |= {(r, a) for a in atoms if a not in gone}
    return out, links


def test_reference_chains(spark):
    rng = random.Random(1)
    residues, atoms, bonds, want, want_links = [], [], [], set(), set()
    for s in range(40):
        sequence = [rng.choice(["AAA", "SSS", "MMM", "NNN", "AAA"]) for _ in range(rng.randrange(1, 6))]
        residues += [(s, "1", r, n) for r, n in enumerate(sequence, 1)]
        observed, pairs = {}, set()
        for chain in "AB":
            for r, n in enumerate(sequence, 1):
                observed.update({len(observed): (chain, r, a) for a in COMPONENTS[n][0] if rng.random() < (0.3 if a in COMPONENTS[n][1] else 0.9)})
        at = {v: i for i, v in observed.items()}
        for i, (c, r, n) in observed.items():
            for p in COMPONENTS[sequence[r - 1]][2]:
                a, b = p.split("-")
                if n == a and (c, r, b) in at:
                    pairs.add((i, at[c, r, b]))
            for x, y in (("C", "N"), ("O3'", "P")):
                if n == x and (c, r + 1, y) in at and rng.random() < 0.8:
                    pairs.add((i, at[c, r + 1, y]))
        for _ in range(rng.randrange(3)):  # bonds that no polymer has
            i, j = rng.sample(sorted(observed), 2) if len(observed) > 1 else (0, 0)
            if observed and observed[i][:2] != observed[j][:2] and (j, i) not in pairs:
                pairs.add((i, j))
        atoms += [(s, i, "1", c, r, n) for i, (c, r, n) in observed.items()]
        bonds += [(s, i, j) for i, j in pairs]
        kept, links = plain(sequence, observed, pairs)
        want |= {(s, *x) for x in kept}
        want_links |= {(s, *x) for x in links}
    comp_atoms = spark.createDataFrame([(n, i, a, a in leaving) for n, (names, leaving, _) in COMPONENTS.items() for i, a in enumerate(names)], "res_name string, pos long, atom_name string, leaving boolean")
    comp_bonds = spark.createDataFrame([(n, *p.split("-")) for n, (_, _, pairs) in COMPONENTS.items() for p in pairs], "res_name string, a string, b string")
    types = spark.createDataFrame(list(TYPES.items()), "res_name string, type string")
    tables = [spark.createDataFrame(residues, "pdb_id long, entity_id string, res_id long, res_name string"), comp_atoms, comp_bonds, types, spark.createDataFrame(atoms, "pdb_id long, atom_idx long, entity_id string, chain_id string, res_id long, atom_name string"), spark.createDataFrame(bonds, "pdb_id long, i long, j long")]
    kept, links = R.reference_chains(*tables)
    assert {(r["pdb_id"], r["res_id"], r["atom_name"]) for r in kept.collect()} == want
    assert {(r["pdb_id"], r["res_id"], r["atom"], r["next_atom"]) for r in links.collect()} == want_links


def test_leaving_groups(spark):
    comp_atoms = spark.createDataFrame([(n, i, a, a in leaving) for n, (names, leaving, _) in COMPONENTS.items() for i, a in enumerate(names)], "res_name string, pos long, atom_name string, leaving boolean")
    comp_bonds = spark.createDataFrame([(n, *p.split("-")) for n, (_, _, pairs) in COMPONENTS.items() for p in pairs], "res_name string, a string, b string")
    groups, mixed = R.leaving_groups(comp_atoms, comp_bonds)
    got = defaultdict(set)
    for r in groups.collect():
        got[r["res_name"], r["centre"], r["grp"]].add(r["atom_name"])
    assert dict(got) == {("AAA", "C", 4): {"OXT"}, ("SSS", "C", 4): {"OXT"}, ("SSS", "SG", 6): {"H1"}, ("SSS", "SG", 7): {"H2", "H3"}, ("MMM", "C", 4): {"OXT"}, ("NNN", "P", 3): {"OP3"}, ("NNN", "O3'", 4): {"HO"}}
    assert [r["res_name"] for r in mixed.collect()] == ["MMM"]
