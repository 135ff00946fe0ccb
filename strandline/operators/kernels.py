"""Numerical kernels that no built-in expression has, one structure at a time."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def typed(df: DataFrame, *columns: str) -> str:
    """Columns of df with their types, as a schema; ids may be numbers or text."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def ids(values: list) -> pd.Series:
    """A column of numbers or text; without rows pandas would take it for numbers, which Arrow does not turn into text."""
    return pd.Series(values, dtype=object)


def kabsch(cross: np.ndarray, reflect: bool = False) -> np.ndarray:
    """Rotation that takes centred predicted points onto true ones, from their 3 x 3 covariance."""
    u, _, vt = np.linalg.svd(cross)
    d = np.ones(3)
    if not reflect and np.linalg.det(u @ vt) < 0:
        d[-1] = -1
    return u @ np.diag(d) @ vt


def aligned_rmsd(atoms: DataFrame, weight: str | None = None) -> DataFrame:
    """RMSD of resolved atoms after the best rigid move, by structure.

    The covariance is summed by the cluster, and the deviation follows from it
    and the spreads, so only sixteen sums of a structure reach the kernel.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = atoms.where("is_resolved").select("pdb_id", w.alias("w"), *AXES, *[f"p{c}" for c in AXES])
    means = rows.groupBy("pdb_id").agg(F.sum("w").alias("sw"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m_{c}") for c in (*AXES, "px", "py", "pz")])
    c = {n: F.col(n) - F.col(f"m_{n}") for n in (*AXES, "px", "py", "pz")}
    sums = rows.join(means, "pdb_id").groupBy("pdb_id").agg(
        F.max("sw").alias("sw"), F.count(F.lit(1)).alias("n"), F.sum(F.col("w") * sum(c[k] * c[k] for k in c)).alias("spread"), *[F.sum(F.col("w") * c[f"p{a}"] * c[b]).alias(f"c_{a}{b}") for a in AXES for b in AXES]
    )

    def run(batches):
        for pdf in batches:
            cross = pdf[[f"c_{a}{b}" for a in AXES for b in AXES]].to_numpy(float).reshape(-1, 3, 3)
            best = [np.trace(kabsch(m).T @ m) if len(pdf) else 0.0 for m in cross]
            rmsd = np.sqrt(np.maximum(pdf["spread"].to_numpy(float) - 2 * np.array(best), 0) / pdf["sw"].to_numpy(float))
            yield pd.DataFrame({"pdb_id": pdf["pdb_id"], "n": pdf["n"], "aligned_rmsd": rmsd})

    return sums.mapInPandas(run, f"pdb_id {atoms.schema['pdb_id'].dataType.simpleString()}, n long, aligned_rmsd double")


def remove_clashing_chains(ratios: DataFrame, pairs: DataFrame, most: float = 0.3) -> DataFrame:
    """Chains to drop, greedily: the chain with the highest share of clashing atoms goes until none exceeds `most`.

    ratios: pdb_id, chain_id, n; pairs: pdb_id, chain_id, other, atoms (of chain_id that clash with other).
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        size, gone = dict(zip(left["chain_id"], left["n"])), []
        clash = {(a, b): n for a, b, n in zip(right["chain_id"], right["other"], right["atoms"])}
        while True:
            share = {a: sum(n for (x, y), n in clash.items() if x == a and y not in gone) / size[a] for a in size if a not in gone}
            worst = min(share, key=lambda a: (-share[a], size[a], a), default=None)
            if worst is None or share[worst] <= most:
                break
            gone.append(worst)
        return pd.DataFrame({"pdb_id": ids([key[0]] * len(gone)), "chain_id": ids(gone), "step": range(len(gone))})

    # Both sides often stem from one table; new names for the columns tell them apart.
    ratios, pairs = (df.toDF(*df.columns) for df in (ratios, pairs))
    return ratios.groupBy("pdb_id").cogroup(pairs.groupBy("pdb_id")).applyInPandas(run, f"{typed(ratios, 'pdb_id', 'chain_id')}, step long")


def contiguous_crop(tokens: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """Windows of neighbouring tokens of each chain, in a seeded order of chains, that fill a budget; tokens has pdb_id, chain_id, token."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(np.random.SeedSequence([seed, zlib.crc32(str(key[0]).encode())]))
        left, rest, out = size, len(pdf), []
        chains = sorted(pdf["chain_id"].unique().tolist())
        for chain in (chains[i] for i in rng.permutation(len(chains))):
            own = pdf.loc[pdf["chain_id"] == chain, "token"].sort_values().to_numpy()
            rest -= len(own)
            most, least = min(left, len(own)), max(0, min(left - rest, len(own)))
            n = int(rng.integers(least, most + 1)) if most else 0
            at = int(rng.integers(0, len(own) - n + 1))
            out += [(chain, t) for t in own[at : at + n]]
            left -= n
        return pd.DataFrame({"pdb_id": ids([key[0]] * len(out)), "chain_id": ids([c for c, _ in out]), "token": [t for _, t in out]})

    return tokens.groupBy("pdb_id").applyInPandas(run, typed(tokens, "pdb_id", "chain_id", "token"))


def global_alignment(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2) -> tuple[str, str]:
    """Two sequences with gaps, by dynamic programming; of equal scores a pairing is taken before a gap in b, and that before one in a.

    Rows of scores are computed as vectors: a run of gaps in a is a running maximum once the gaps' cost is taken out. Every
    sqrt(n)-th row is kept and the rows between are computed again on the way back, so memory grows with m sqrt(n).
    """
    n, m = len(a), len(b)
    left, top = (np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in (a, b))
    run = np.arange(m + 1, dtype=np.int32) * np.int32(gap)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        """Row i from the row above it."""
        out = np.empty_like(row)
        out[0] = i * gap
        out[1:] = np.maximum(row[:-1] + np.where(top == left[i - 1], match, mismatch).astype(np.int32), row[1:] + gap)
        return np.maximum.accumulate(out - run) + run

    block = max(1, int(n**0.5))
    kept, row = [run], run
    for i in range(1, n + 1):
        row = below(row, i)
        if i % block == 0:
            kept.append(row)
    x, y, i, j = [], [], n, m
    while i:
        start = (i - 1) // block * block
        rows = [kept[start // block]]
        for k in range(start + 1, i + 1):
            rows.append(below(rows[-1], k))
        while i > start:
            here, above = rows[i - start], rows[i - start - 1]
            if j and here[j] == above[j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                i, j = i - 1, j - 1
                x.append(a[i]), y.append(b[j])
            elif here[j] == above[j] + gap:
                i -= 1
                x.append(a[i]), y.append("-")
            else:
                j -= 1
                x.append("-"), y.append(b[j])
    return "-" * j + "".join(x[::-1]), b[:j] + "".join(y[::-1])
