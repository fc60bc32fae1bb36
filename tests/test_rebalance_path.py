"""The rebalance path against a loop over bars with plain dictionaries."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from barspan.operators import portfolio as H

T0 = datetime(2024, 1, 1)
FIELDS = ("mu", "rets", "prices", "step_size", "min_qty", "min_notional", "multiplier")
SCHEMA = "bar_ts timestamp_ntz, symbols array<string>, " + ", ".join(f"{c} array<double>" for c in FIELDS) + ", cov array<double>"
GRID = [("free", 5.0, 0.0, 0.0), ("pull", 5.0, 0.1, 0.0), ("tight", 1.0, 0.1, 1.0)]


def table():
    rng, out = np.random.default_rng(3), []
    for i in range(60):
        names = ["A", "B", "C"] if i % 9 else ["A", "B"]
        n = len(names)
        x = rng.normal(0, 0.02, (30, n))
        cov = [float(v) for v in np.cov(x.T).ravel()]
        cov = None if i < 2 else cov[:-1] if i in (20, 21) else cov
        mu = [None] * n if i == 30 else [float(v) for v in rng.normal(0.0, 0.003, n)]
        rets = [-0.2] * n if i in (21, 40, 41) else [float(v) for v in rng.normal(0, 0.03, n)]
        out.append((T0 + timedelta(days=i), names, mu, rets, [50.0, 20.0, 900.0][:n], [0.01] * n, [0.02] * n, [10.0] * n, [1.0] * n, cov))
    return out


def clamp(w):
    net = sum(w.values())
    if abs(net) > 0.25:
        w = {s: v - (net - np.sign(net) * 0.25) / len(w) for s, v in w.items()}
    return {s: min(0.3, max(-0.3, v)) for s, v in w.items()}


def loop(rows, gamma, lam, budget):
    nav, held, peak, navs, out = 10_000.0, {}, 0.0, [], {}
    for t, names, mu, rets, prices, step, min_qty, least, _, cov in rows:
        nav *= 1 + sum(held.get(s, 0.0) * r for s, r in zip(names, rets))
        n = len(names)
        reason = "empty forecast" if all(m is None for m in mu) else "missing covariance" if cov is None or len(cov) < n * n else None
        new = held
        if reason is None:
            c, k, m = np.array(cov).reshape(n, n), np.ones(n), np.array(mu)
            if held and lam > 0:
                k = k * 1.0005
                m = m + 2 * lam * k * np.array([held.get(s, 0.0) for s in names])
            raw = np.clip(np.linalg.solve(gamma * c + 2 * lam * np.diag(k), m), -0.3, 0.3)
            if abs(raw).sum() > 1.2:
                raw = raw * 1.2 / abs(raw).sum()
            w = np.array(list(clamp(dict(zip(names, raw))).values()))
            peak, navs = max(peak, nav), navs + [nav]
            down = (peak - nav) / peak
            share = 0.1 if down >= 0.2 else 0.25 if down >= 0.1 else 0.4 if down >= 0.05 else 0.5
            if len(navs) >= 5:
                vol = np.std(np.diff(navs) / navs[:-1], ddof=1)
                share = share / (1 + max(0.0, vol - 0.05))
            kelly = share * min(2.0, max(0.0, (np.array(mu) @ w) / (w @ c @ w)))
            limits = [0.3 / abs(v) for v in w if v] + [1.2 / abs(w).sum(), 0.25 / abs(w.sum())]
            target = clamp({s: v * min(kelly, *limits) for s, v in zip(names, w)})
            union = sorted(set(target) | set(held))
            cost = sum(abs(target.get(s, 0.0) - held.get(s, 0.0)) for s in union) * 9.0
            if budget > 0 and cost > budget:
                target = clamp({s: held.get(s, 0.0) + (target.get(s, 0.0) - held.get(s, 0.0)) * budget / cost for s in union})
            orders = 0
            for i, s in enumerate(names):
                d = target[s] - held.get(s, 0.0)
                q = np.floor((abs(d) * nav / prices[i] + 1e-12) / step[i]) * step[i]
                orders += abs(d) >= 1e-4 and abs(d) * nav >= least[i] and q >= min_qty[i] and q > 0 and q * prices[i] >= least[i]
            reason, new = (None, target) if orders else ("portfolio already aligned", held)
        for s in sorted(set(names) | set(held)):
            out[t, s] = (new.get(s, 0.0), nav, reason)
        held = new
    return out


@pytest.fixture(scope="module")
def path(spark):
    grid = spark.createDataFrame(GRID, "strategy_id string, gamma double, lam double, budget_bp double")
    return H.rebalance_path(spark.createDataFrame(table(), SCHEMA).repartition(5), grid).toPandas()


def test_path_equals_loop(path):
    for sid, *p in GRID:
        want, mine = loop(table(), *p), path[path.strategy_id == sid]
        assert len(mine) == len(want)
        for r in mine.itertuples():
            weight, nav, reason = want[r.bar_ts.to_pydatetime(), r.symbol]
            assert np.isclose(r.weight, weight, atol=1e-9) and np.isclose(r.nav, nav, rtol=1e-9)
            assert r.reason == reason or (reason is None and r.reason is None), (sid, r)
            assert r.status == ("skipped" if reason else "completed")


def test_skipped_bars_move_nav_and_stay_as_rows(path):
    one = path[path.strategy_id == "pull"].drop_duplicates("bar_ts").sort_values("bar_ts").reset_index()
    assert len(one) == 60
    assert list(one.reason[:2]) == ["missing covariance"] * 2 and one.reason[20] == one.reason[21] == "missing covariance" and one.reason[30] == "empty forecast"
    assert one.nav[21] != one.nav[20]
    assert any(x is True for x in path.limited) and path.skip_reason.notna().any() and (path.side == "sell").any()
