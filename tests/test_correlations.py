"""Correlations of few and of many columns against numpy."""

import math
import random

import numpy as np
import pytest

from retentio.operators import stats as st


def table(spark, p, n=120, seed=1):
    rng = random.Random(seed)
    cols = []
    for j in range(p):
        base = [rng.gauss(0, 1) for _ in range(n)] if j % 4 else [1e6 + rng.random() for _ in range(n)]
        if j % 3 == 0 and j:
            base = [0.3 * b + (a if a is not None and math.isfinite(a) else 0.0) for a, b in zip(cols[-1], base)]
        if j % 5 == 1:
            base = [rng.choice([v, None, float("nan")]) if rng.random() < 0.3 else v for v in base]
        if j == 2:
            base = [7.1] * n
        if j == 7:
            base[3] = float("inf")
        cols.append(base)
    rows = list(zip(*cols))
    return spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(p))).repartition(5), cols


def by_hand(cols):
    out = {}
    x = [np.array([float("nan") if v is None else v for v in c]) for c in cols]
    for a in range(len(x)):
        for b in range(a + 1, len(x)):
            both = ~np.isnan(x[a]) & ~np.isnan(x[b])
            u, v = x[a][both], x[b][both]
            if not len(u) or np.isinf(u).any() or np.isinf(v).any() or (u == u[0]).all() or (v == v[0]).all():
                out[a, b] = None
            else:
                out[a, b] = float(np.corrcoef(u, v)[0, 1])
    return out


@pytest.mark.parametrize("p,cells", [(9, None), (9, 40), (30, 200), (30, 1 << 20)])
def test_correlations_match_numpy(spark, p, cells):
    df, cols = table(spark, p)
    names = [f"c{j}" for j in range(p)]
    if cells is None:
        got = st.correlation_pairs(df, names)
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    else:
        got = st.strip_correlations(df, names, cells)
    got = {(r.ordinal_a, r.ordinal_b): r.corr for r in got.collect()}
    want = by_hand(cols)
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (r is None) == (got[k] is None), k
        assert r is None or abs(r - got[k]) < 1e-7, k


def test_two_thousand_columns_and_a_filter_over_them(spark):
    p = 2000
    rng = np.random.default_rng(2)
    x = rng.normal(size=(24, p)).round(3)
    x[:, 1999] = 2 * x[:, 0] + 1
    rows = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>")
    df = rows.select(*[rows.v[j].alias(f"c{j}") for j in range(p)])
    got = st.correlation_pairs(df, df.columns)
    assert got.count() == p * (p - 1) // 2
    twin = got.where("ordinal_b = 1999").orderBy(got["corr"].desc()).first()
    assert (twin.feature_a, twin.feature_b) == ("c0", "c1999") and abs(twin["corr"] - 1) < 1e-9


def test_no_rows_and_one_column(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [r["corr"] for r in st.correlation_pairs(empty, ["a", "b"]).collect()] == [None]
    assert st.strip_correlations(empty, ["a", "b"]).count() == 0
    assert st.correlation_pairs(empty, ["a"]).count() == 0
