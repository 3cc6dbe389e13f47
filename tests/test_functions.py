import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavetally.functions import signals, stats, waveforms


def test_poisson_without_events():
    low, high, one = stats.poisson_rate(0, 100.0)
    assert low == 0.0 and one == pytest.approx(-math.log(0.05) / 100, rel=1e-12) and high == pytest.approx(-math.log(0.025) / 100, rel=1e-12)


def test_clopper_pearson_edges_and_golden_values():
    assert stats.clopper_pearson(0, 10)[0] == 0.0 and stats.clopper_pearson(10, 10)[1] == 1.0
    low, high = stats.clopper_pearson(2179, 2563)
    assert (low, high) == (pytest.approx(0.8357641255399916, rel=1e-12), pytest.approx(0.8637818953709386, rel=1e-12))
    low, high, _ = stats.poisson_rate(323, 177.13277777777776)
    assert (low, high) == (pytest.approx(1.6300294138832712, rel=1e-12), pytest.approx(2.033597345684626, rel=1e-12))


@given(st.integers(1, 60), st.data())
@settings(max_examples=25, deadline=None)
def test_binomial_interval_solves_its_tails(n, data):
    k = data.draw(st.integers(0, n))
    low, high = stats.clopper_pearson(k, n)
    tail = lambda p, a, b: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(a, b + 1))
    assert low == 0 or tail(low, k, n) == pytest.approx(0.025, rel=1e-6)
    assert high == 1 or tail(high, 0, k) == pytest.approx(0.025, rel=1e-6)


def naive_suppression(c, s, a, m, r):
    order = sorted(range(len(c)), key=lambda k: (-s[k], -abs(a[k]), abs(m[k] - 1), k))
    kept = []
    for k in order:
        if all(abs(c[k] - c[j]) > r for j in kept):
            kept.append(k)
    return sorted(kept, key=lambda k: (c[k], k))


@pytest.mark.parametrize("radius", [0, 0.3, 1, 3.5, 10])
def test_suppression_is_the_naive_one(radius):
    rng = np.random.default_rng(3)
    c, s, a, m = rng.integers(-20, 200, 500) / 2, rng.random(500), rng.uniform(0.5, 5, 500), rng.choice([0.9, 1.0, 1.1], 500)
    assert signals.suppress(c, s, a, m, radius).tolist() == naive_suppression(c, s, a, m, radius)


def test_suppression_of_many_centres():
    assert len(signals.suppress(np.arange(20_000.0), np.ones(20_000), np.ones(20_000), np.ones(20_000), 0)) == 20_000


def test_correlation_finds_a_template_of_either_sign():
    t = waveforms.render("SSLSLSLL", waveforms.Waveform())
    x = np.random.default_rng(0).normal(0, 0.01, 3000)
    x[500 : 500 + len(t)] -= 3 * t
    at, score, amp, ok = signals.correlate(x, t)
    assert at[np.argmax(np.abs(score))] == 500 and score[500] < -0.999 and amp[500] == pytest.approx(-3, abs=0.05) and ok.all()


def test_correlation_of_a_long_signal_with_a_hole():
    x = np.random.default_rng(1).normal(size=300_000)
    x[1000:1010] = np.nan
    at, _, _, ok = signals.correlate(x, waveforms.render("EEE", waveforms.Waveform()), step=5)
    n = len(waveforms.render("EEE", waveforms.Waveform()))
    assert (~ok).sum() == len([s for s in range(0, 300_000 - n + 1, 5) if s < 1010 and s + n > 1000]) and len(at) == len(ok)


def test_maxima_take_the_last_of_a_plateau():
    s, q = np.array([1, 2, 2, 1, 3, 3.0]), np.array([1, 1, 1, 1, 1, 0], bool)
    assert signals.local_maxima(s, q).tolist() == [2, 4]


def test_filter_has_zero_phase_unit_gain_and_no_constant():
    sos = signals.butterworth_bandpass(100, 0.1, 8)
    t = np.arange(6000) / 100
    y = signals.zero_phase(np.sin(2 * np.pi * 1.0 * t) + 5, sos)
    assert np.abs(y[2000:4000] - np.sin(2 * np.pi * 1.0 * t)[2000:4000]).max() < 0.01
    assert np.abs(signals.zero_phase(np.sin(2 * np.pi * 30 * t), sos)[2000:4000]).max() < 0.02  # end transients
    edge = abs(np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in sos for z in [np.exp(2j * np.pi * 8 / 100)]]))
    assert edge == pytest.approx(math.sqrt(0.5), rel=1e-9)


def test_resampling_keeps_length_and_shape():
    x = np.sin(2 * np.pi * np.arange(128 * 90) / 128)
    y = signals.resample(x, 128, 100)
    assert len(y) == 9000 and np.abs(y[500:8500] - np.sin(2 * np.pi * np.arange(9000) / 100)[500:8500]).max() < 5e-3


def test_gaps_mad_matches_anchors():
    assert signals.fill_gaps(np.array([np.nan, 1, np.nan, 3, np.inf])).tolist() == [1, 1, 2, 3, 3]
    assert signals.robust_mad(np.array([0, 1, 2, np.nan, np.inf])) == pytest.approx(1.4826)
    got = signals.choose_anchors(np.ones(1000, bool), 50, 100, 5, np.random.default_rng(0))
    assert len(got) == 5 and (np.diff(got) >= 100).all() and got.max() <= 950


def test_waveform_rules():
    w = waveforms.Waveform()
    assert waveforms.samples_of(0.025, 100) == 2 and waveforms.samples_of(0.035, 100) == 4
    x = waveforms.render("EPE", w)
    assert x.max() == 1.0 and x.min() >= 0.0  # a pause resets polarity
    assert len(waveforms.perturbed("SSLL", w, 2.0, np.random.default_rng(0), waveforms.Perturbation(jitter=0.15))) <= waveforms.longest_injection(["SSLL"], w, 0.15, 0.15)
    with pytest.raises(ValueError):
        waveforms.render("PP", w)
