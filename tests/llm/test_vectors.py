"""Whitening against exact sums and a dense eigendecomposition, on odd rows, ties, low rank and far entries."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, component string"


def vectors(rows: int, dims: int, seed: int) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((rows, dims)) * np.linspace(2, 0.5, dims) * 0.1).tolist()


def expected(kept: list[list[float]], components: int):
    """n, exact deviations, whitened values and shares, by the definitions."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, q = np.linalg.eigh(y.T @ y / n)
    values, q = values[::-1][:components], q[:, ::-1][:, :components]
    return n, deviation, y @ q / np.sqrt(values), values / np.trace(y.T @ y / n)


def compared(df, kept: list[tuple], components: int = 8, close: float = 1e-9):
    n, deviation, white, share = expected([v for _, v in kept], components)
    rows = df.collect()
    assert len(rows) == n * components and {r["n"] for r in rows} == {n}
    assert max(r["identity_error"] for r in rows) < 1e-9 and len({r["identity_error"] for r in rows}) == 1
    for r in rows:
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-10)
    ids = {i: k for k, (i, _) in enumerate(kept)}
    ours = np.zeros((n, components))
    for r in rows:
        assert r["deviation"] == deviation[ids[r["vec_id"]]]
        ours[ids[r["vec_id"]], r["component"] - 1] = r["whitened"]
    ours *= np.sign((ours * white).sum(0))
    assert np.abs(ours - white).max() < close


def test_whitening_matches_a_dense_eigendecomposition(spark):
    """40 dimensions and 24 columns: what the block does not hold has to be damped by the filter."""
    kept = list(enumerate(vectors(300, 40, 1)))
    nan, wide = float("nan"), [0.0] * 40
    odd = [(900, None), (901, [nan, *wide[1:]]), (902, [math.inf, *wide[1:]]), (903, [None, *wide[1:]]), (904, [1e300, *wide[1:]]), (905, [0.5] * 3), (906, [])]
    df = spark.createDataFrame([(i, v, 1, 7, "x") for i, v in [*kept, *odd]], SCHEMA).repartition(5)
    compared(whitening.whiten(spark, df), kept)


def test_filter_is_what_converges(spark):
    """The spectrum is nearly flat beyond the block, so without the recurrence the residual would stay."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate([np.linspace(1.05, 1.02, 12), np.linspace(1.0, 0.9, 108)])
    v = q * values @ q.T
    passes, plain = [0], [0]

    def apply(columns, count=passes):
        count[0] += 1
        return v @ columns

    found, vectors_ = whitening.principal(apply, 120, 8)
    assert np.abs(found - values[:8]).max() < 1e-12
    assert np.abs(np.abs(np.sum(vectors_ * q[:, :8], 0)) - 1).max() < 1e-12
    assert np.abs(v @ vectors_ - vectors_ * found).max() < 1e-11
    block = np.linalg.qr(rng.standard_normal((120, 24)))[0]
    for _ in range(passes[0]):
        block = np.linalg.qr(apply(block, plain))[0]
    small, turn = np.linalg.eigh(block.T @ v @ block)
    block = block @ turn[:, ::-1][:, :8]
    assert np.abs(v @ block - block * small[::-1][:8]).max() > 1e-4


@pytest.mark.parametrize("spectrum", [[1.0] * 30, [5.0] * 10 + [1.0] * 20, [3.0, 2.0] + [0.0] * 28, [1e8, 1.0, 1.0] + [0.5] * 27])
def test_ties_and_gaps_of_any_size_are_certified(spectrum):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((30, 30)))[0]
    v = q * np.array(spectrum) @ q.T
    found, vectors_ = whitening.principal(lambda c: v @ c, 30, 8)
    assert np.abs(found - spectrum[:8]).max() < 1e-11 * spectrum[0]
    assert np.abs(vectors_.T @ vectors_ - np.eye(8)).max() < 1e-12
    assert np.abs(v @ vectors_ - vectors_ * found).max() < 1e-11 * spectrum[0]


def test_low_rank_repeated_and_few_rows(spark):
    base = vectors(6, 5, 3)
    rows = [(None, base[0]), (1, base[1]), (1, base[1]), (2, base[2])]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
    found = whitening.whiten(spark, df).collect()
    assert len(found) == 4 * 2 and {r["component"] for r in found} == {1, 2} and sum(r["vec_id"] is None for r in found) == 2
    assert max(r["identity_error"] for r in found) < 1e-9 and sum({r["explained"] for r in found}) == pytest.approx(1)
    same = spark.createDataFrame([(1, base[0], 0, 0, ""), (2, base[0], 0, 0, "")], SCHEMA)
    one, none = same.limit(1), same.limit(0)
    for empty in (same, one, none, same.withColumn("embedding", F.lit(None).cast("array<double>"))):
        assert whitening.whiten(spark, empty).collect() == []
    assert whitening.whiten(spark, none).schema == whitening.whiten(spark, df).schema


def test_entries_that_need_eight_bytes_keep_exact_deviations(spark):
    kept = [(i, [c * 1e9 for c in v]) for i, v in enumerate(vectors(40, 3, 4))]
    df = spark.createDataFrame([(i, v, 0, 0, "") for i, v in kept], SCHEMA)
    n, deviation, *_ = expected([v for _, v in kept], 3)
    assert max(deviation) > 2**63
    found = {(r["vec_id"], r["component"]): r["deviation"] for r in whitening.whiten(spark, df).collect()}
    assert all(found[i, c] == (d if d < 2**63 else None) for i, d in enumerate(deviation) for c in (1, 2, 3))


def test_query_covers_every_vector(spark, sf):
    found = whitening.op12_embedding_whitening(spark, sf)
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    compared(found, rows)
