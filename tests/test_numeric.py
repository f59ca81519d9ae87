import math

import numpy as np
import pytest

from gridsquall.functions import numeric as N


def test_special_functions():
    assert N.norm_cdf(1.959964) == pytest.approx(0.975, abs=1e-6)
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 1 - 1e-6])
    assert N.norm_cdf(N.norm_ppf(p)) == pytest.approx(p, rel=1e-9)
    assert N.bivariate_norm_cdf(0, 0, 0.5) == pytest.approx(0.25 + math.asin(0.5) / (2 * math.pi), abs=1e-9)
    assert N.poisson_ppf(0.975, 4.0) == 8 and N.poisson_ppf(0.025, 4.0) == 1
    assert N.betainc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    assert N.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)


def test_simplex_search():
    x, v, ok = N.nelder_mead(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] + 1) ** 2, [0, 0])
    assert ok and x == pytest.approx([3, -1], abs=1e-3) and v < 1e-6


@pytest.mark.parametrize("xi", [-0.2, 0.0, 0.2])
def test_gpd_recovery(xi):
    u = np.random.default_rng(1).random(3000)
    y = -0.5 * np.log(u) if xi == 0 else 0.5 * (u**-xi - 1) / xi
    f = N.fit_gpd(y)
    assert f["converged"] and abs(f["xi"] - xi) < 3 * f["se_xi"] and abs(f["sigma"] - 0.5) < 3 * f["se_sigma"]


def test_extremal_index():
    rng = np.random.default_rng(2)
    assert N.ferro_segers(rng.exponential(100, 3000)) > 0.9
    assert N.ferro_segers(np.where(rng.random(3000) < 0.7, 1, rng.exponential(300, 3000))) < 0.5
    assert N.ferro_segers([1, 2]) == 1.0


def test_declustering_keeps_the_first_largest():
    t, x = [0, 1, 2, 50, 51, 200], [1, 3, 3, 2, 1, 5]
    assert N.decluster(t, x, 10).tolist() == [1, 3, 5]
    assert N.decluster([], [], 10).tolist() == []


@pytest.mark.parametrize("seed", range(5))
def test_swinging_door_error_is_bounded(seed):
    rng = np.random.default_rng(seed)
    v = np.cumsum(rng.normal(size=300)) * 0.05
    at = N.swinging_door(v, 0.1)
    assert at[0] == 0 and at[-1] == 299 and at == sorted(set(at))
    line = np.interp(np.arange(300), at, v[at])
    assert np.abs(line - v).max() <= 0.2 + 1e-9


def test_swinging_door_shapes():
    flat = 0.5 + 0.005 * np.sin(np.arange(100))
    assert max(abs(np.diff(flat[N.swinging_door(flat, 0.02)]))) < 0.1
    one = np.concatenate([np.zeros(30), np.linspace(0, 1, 30), np.ones(30)])
    assert sum(abs(np.diff(one[N.swinging_door(one, 0.02)])) >= 0.1) == 1
    two = np.concatenate([one, one[::-1]])
    assert sum(abs(np.diff(two[N.swinging_door(two, 0.02)])) >= 0.1) == 2
    assert N.swinging_door([], 0.1) == [] and N.swinging_door([1.0], 0.1) == [0]


def test_conditional_extremes_recovery():
    rng = np.random.default_rng(3)
    x, d = rng.exponential(1, 4000) + 1, rng.uniform(0, 5, 4000)
    y = 0.6 * np.exp(-d / 3.5) * x + x**0.3 * (0.1 + 0.4 * rng.normal(size=4000))
    f = N.fit_heffernan_tawn(x, y, d, "exp")
    assert f["alpha0"] == pytest.approx(0.6, abs=0.1) and f["decay"] == pytest.approx(3.5, abs=0.9)


def test_return_level_limit():
    assert N.return_level(0.2, 0.1, 1e-9, 50, 2) == pytest.approx(N.return_level(0.2, 0.1, 1e-5, 50, 2), abs=1e-3)
