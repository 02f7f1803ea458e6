"""Singular vectors by block Lanczos, against numpy."""

import inspect

import numpy as np

from lexispark.operators import svd
from lexispark.operators import vectors as V


def test_block_lanczos_against_numpy(spark):
    """Several steps and passes give numpy's singular values and spaces."""
    rng = np.random.default_rng(5)
    tf = np.where(rng.random((300, 160)) < 0.1, rng.integers(1, 9, (300, 160)), 0)
    tf[:, 7] = tf[:, 9]  # a copy
    entries = [(f"t{i}", int(j), int(tf[i, j])) for i, j in np.argwhere(tf)]
    rows = svd.saved_rows(spark.createDataFrame(entries, "term string, n long, tf long"), 2)
    got = {r["term"]: r["vec"] for r in svd.term_vectors(rows, *svd.decomposed(rows, 160, 23)).collect()}
    kept = np.flatnonzero((tf > 0).sum(1) >= 2)
    a = np.log1p(tf[kept]) * np.log(160 / (tf[kept] > 0).sum(1))[:, None]
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    have = np.array([got[f"t{i}"] for i in kept])
    assert have.shape == (len(kept), 23)
    assert np.allclose(have.T @ have, np.eye(23), atol=1e-8)
    assert np.allclose(np.linalg.norm(a.T @ have, axis=0), s[:23], rtol=1e-8)
    assert np.allclose(have @ have.T, u[:, :23] @ u[:, :23].T, atol=1e-6)


def test_vectors_stay_out_of_the_driver():
    """Neither MLlib's solver nor a broadcast of term vectors is part of the decomposition."""
    assert "computeSVD" not in inspect.getsource(V) and ".broadcast(v)" not in inspect.getsource(V)
