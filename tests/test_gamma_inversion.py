"""The inverse of the gamma hazard against its closed form, and the work it takes."""

import math

import numpy as np
import pytest

from lineagelake.functions import hazards


@pytest.mark.parametrize("shape", [1.0, 4.0])
def test_gamma_inversion_takes_few_rounds(monkeypatch, shape):
    calls, plain = [], hazards._log_upper_gamma
    monkeypatch.setattr(hazards, "_log_upper_gamma", lambda a, x: calls.append(len(x)) or plain(a, x))
    h = np.random.default_rng(1).exponential(1, 2000) * np.exp(np.random.default_rng(2).normal(0, 1.5, 2000))
    x = hazards.gamma_isf(shape, h)
    back = x - np.log(sum(x**k / math.factorial(k) for k in range(int(shape))))  # -log of a whole shape's upper tail
    assert np.allclose(back, h, rtol=1e-9, atol=1e-13)
    assert sum(calls) <= 20 * len(h)  # 80 rounds over all values before
    odd = hazards.gamma_isf(shape, np.array([0.0, np.inf, np.nan]))
    assert odd[0] == pytest.approx(math.exp(-60), rel=1e-6) and odd[1] == pytest.approx(math.exp(20), rel=1e-6) and odd[2] == math.exp(-60)
