"""Permutations backwards, values held in parts, and counts and totals made inside tasks."""

import numpy as np
import pytest

from dosewise.functions import shuffles
from dosewise.operators import resample

from test_shuffles import brute_sums, table


@pytest.mark.parametrize("n", [1, 2, 5, 66, 4097])
def test_backwards_is_the_inverse(n):
    keyed = shuffles.round_keys(42, 7, np.arange(1, 21))
    there = shuffles.permuted_positions(keyed, np.arange(n), n)
    back = shuffles.permuted_positions(keyed, np.arange(n), n, back=True)
    assert (np.take_along_axis(back, there, axis=1) == np.arange(n)).all()


def test_values_are_held_in_parts(spark, monkeypatch):
    """A tile meets the y of its group part by part; no value is sent per replicate."""
    for name, value in (("SLICE_ROWS", 7), ("BLOCK_REPS", 4), ("AT_ONCE", 50), ("HELD", 20), ("TILE_SLICES", 3), ("FAR_TASKS", 9)):
        monkeypatch.setattr(resample, name, value)
    rows, df = table(spark)
    want = brute_sums(rows, 10, True, True, False)
    got = resample.shuffled_sums(df, ["g"], ["a", "b"], "y", ["i"], 10, 42, acc="part").collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r["sy"], r["syy"], *r["sxy"]], want[(r["g"], r["part"], r["rep"])], atol=1e-9)


@pytest.mark.parametrize("within", [(), ("part",)])
def test_groups_are_counted_where_they_lie(spark, monkeypatch, within):
    """One row per group and block, or per replicate, leaves a task; short and long groups give the same counts."""
    _, df = table(spark)
    run = lambda: sorted(map(tuple, resample.permutation_test(df, ["g"], "a", "y", ["i"], 60, within=within).collect()), key=str)
    short = run()
    monkeypatch.setattr(resample, "SLICE_ROWS", 11)
    for one, other in zip(run(), short, strict=True):
        assert one[0] == other[0] and one[1:] == pytest.approx(other[1:])
    assert {r[3] for r in short} == {60}


def test_totals_weigh_their_groups():
    import pyarrow as pa

    into = shuffles.Totals(0, lines=2, squares=1)
    s = [np.array([[1.0, 2.0], [3.0, 4.0]]), np.array([[5.0, 6.0], [7.0, 8.0]])]
    w = [[1.0, 0.5, 2.0, -1.0, 0.0, 3.0], [2.0, 1.0, 1.0, 1.0, 1.0, 1.0]]
    batch = pa.record_batch({"__w": pa.array(w)})
    for i in (0, 1):
        sums = np.concatenate([np.zeros((1, 2, 2)), s[i][None]], axis=2)
        assert list(into.add(batch, i, None, np.array([1, 2]), sums) or ()) == []
    out = next(into.end())
    want = [[sum(v for k in (0, 1) for v in [f(s[k][r][x], w[k][3 * x:3 * x + 3])]) for x in (0, 1) for f in (lambda z, u: z * u[0], lambda z, u: z * u[1], lambda z, u: z * z * u[2])] for r in (0, 1)]
    assert out.column("rep").to_pylist() == [1, 2] and np.allclose(out.column("sums").to_pylist(), want)
