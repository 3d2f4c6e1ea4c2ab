"""The novelty gate in blocks and rounds against a plain fold."""

import numpy as np
import pytest

from engram.operators import novelty as N
from engram.streaming import log as SL

SCHEMA = "graph_key string, place long, embedding array<double>"


def fold(rows, threshold, known=()):
    """Verdicts by the rule as it is stated: one row after the other."""
    held, out = {}, {}
    for g, v in known:
        held.setdefault((g, len(v)), []).append(np.array(v) / np.linalg.norm(v))
    for g, place, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        x = None if v is None else np.array([np.nan if c is None else c for c in v], float)
        if x is None or not np.isfinite(x).all() or not x.any():
            out[g, place] = (None, False)
            continue
        x = x / np.abs(x).max()
        x /= np.linalg.norm(x)
        near = held.setdefault((g, len(x)), [])
        distance = round(1 - max(float(y @ x) for y in near), 9) if near else None
        taken = distance is None or threshold is None or distance >= threshold
        if taken:
            near.append(x)
        out[g, place] = (distance, taken)
    return out


def same(got, want):
    assert set(got) == set(want)
    for k, (distance, taken) in want.items():
        assert got[k][1] == taken, (k, got[k], want[k])
        assert got[k][0] is None if distance is None else got[k][0] == pytest.approx(distance, abs=2e-9), k


def run(spark, rows, threshold, known=None):
    known = None if known is None else spark.createDataFrame(known, "graph_key string, embedding array<double>")
    return {(r.graph_key, r.place): (r.distance, r.admitted) for r in N.gate(spark.createDataFrame(rows, SCHEMA), threshold, known).collect()}


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6))
    return [(["a", "a", "a", None][i % 4], i * 3, [float(x) for x in centres[rng.integers(12)] + 0.3 * rng.normal(size=6)]) for i in range(n)]


UNSOUND = [("a", -9, [0.0] * 6), ("b", -3, None), ("b", -2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), ("c", 1, [float("nan")] * 6), ("c", 2, [float("inf")] + [1.0] * 5), ("c", 3, [1.0] * 6), ("b", 5, [])]


@pytest.mark.parametrize("block", [4096, 16])
def test_clusters_and_unsound_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = clustered(120) + UNSOUND + [("a", 9000, [1e200, 1e200, 0.0, 0.0, 0.0, 0.0]), ("a", 9001, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), ("a", 9002, [1.0, 0.0])]
    same(run(spark, rows, 0.15), fold(rows, 0.15))


def test_a_chain_settles_block_by_block(spark, monkeypatch):
    """Each row is near to the one before only, so that every verdict hangs on the last."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rows = [("z", i, [float(np.cos(i * 0.01)), float(np.sin(i * 0.01)), i / 40]) for i in range(40)]
    same(run(spark, rows, 0.002), fold(rows, 0.002))


def test_known_rows_and_no_threshold(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 10)
    rows, known = clustered(50), [(g, v) for g, _, v in clustered(25, seed=2)] + [("a", [0.0] * 6), ("nobody", [1.0] * 6)]
    sound = [(g, v) for g, v in known if any(v)]
    same(run(spark, rows, 0.15, known), fold(rows, 0.15, sound))
    same(run(spark, rows[:25] + UNSOUND, None), fold(rows[:25] + UNSOUND, None))
    assert run(spark, [], 0.15) == {}


def test_batches_run_again_replace_themselves(spark, tmp_path):
    rows = clustered(60)
    for number, part in ((0, rows[:30]), (1, rows[30:]), (1, rows[30:])):
        SL.gate_batch(spark.createDataFrame(part, SCHEMA), number, str(tmp_path), 0.15)
    got = {(r.graph_key, r.place): (r.distance, r.admitted) for r in spark.read.parquet(str(tmp_path / "verdicts")).collect()}
    same(got, fold(rows, 0.15))
