"""Numerical kernels of one recording: filters, resampling, correlation, detection.

They run inside grouped functions, one recording (or chunk with its halo) at a time.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np


def butterworth_bandpass(rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) by the bilinear transform."""
    if not 0 < low < high < rate / 2 or order < 1:
        raise ValueError("need 0 < low < high < half the rate")
    warp = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = warp[1] - warp[0], math.sqrt(warp[0] * warp[1])
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(proto**2 - centre**2)
    poles = np.concatenate((proto + root, proto - root))
    z = (2 * rate + poles) / (2 * rate - poles)
    upper = z[z.imag > 1e-12]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in sorted(upper, key=abs)]
    pairs += [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    sos = np.array([[1.0, 0.0, -1.0, 1.0, a1, a2] for a1, a2 in pairs])
    at = np.exp(2j * np.pi * math.atan(centre / (2 * rate)) / np.pi)  # the centre has unit gain
    gain = np.prod([(s[0] + s[1] / at + s[2] / at**2) / (1 + s[4] / at + s[5] / at**2) for s in sos])
    sos[0, :3] /= abs(gain)
    return sos


class _Section:
    """One second-order section as a linear system whose two-number state turns and shrinks
    with its pair of poles (a real pair keeps the plain form): z goes over n samples to
    A^n z + c, where c depends on the samples alone. Samples are done in rows of ``width``:
    outputs and final states from a zero state by matrix products, the states between rows by
    a prefix scan of those maps."""

    def __init__(self, row: np.ndarray, width: int):
        b0, b1, b2, _, a1, a2 = np.asarray(row, float).tolist()
        a, b, c = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([1.0, 0.0])
        if a1 * a1 < 4 * a2:  # coordinates in which A is a rotation times a number
            re, im = -a1 / 2, math.sqrt(a2 - a1 * a1 / 4)
            to = np.array([[1.0, 0.0], [-(-a1 - re) / im, -1.0 / im]])
            back = np.linalg.inv(to)
            a, b, c = np.array([[re, -im], [im, re]]), to @ b, c @ back
        self.a, self.b, self.c, self.d = a, b, c, b0
        powers = [np.eye(2)]
        for _ in range(width):
            powers.append(a @ powers[-1])
        self.powers, self.width = powers, width
        self.answer = np.array([c @ p for p in powers[:width]])  # outputs that a state gives
        self.gather = np.array([p @ b for p in powers[width - 1 :: -1]])  # a sample's part in the final state
        impulse = np.concatenate(([b0], self.answer[:-1] @ b))
        at = np.arange(width)
        self.toeplitz = np.where(at[:, None] >= at, impulse[np.abs(at[:, None] - at)], 0.0)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, w = len(x), self.width
        full = n // w
        rows = x[: full * w].reshape(full, w)
        states = np.concatenate((z[None], rows @ self.gather))  # at the start of each row, once summed up
        step, leap = 1, self.powers[w].T
        while step <= full:
            states[step:] = states[step:] + states[:-step] @ leap
            step, leap = 2 * step, leap @ leap
        out = np.empty(n)
        out[: full * w] = (rows @ self.toeplitz.T + states[:-1] @ self.answer.T).ravel()
        z, rest = states[-1], x[full * w :]
        k = len(rest)
        if k:
            out[full * w :] = self.toeplitz[:k, :k] @ rest + self.answer[:k] @ z
            z = self.powers[k] @ z + rest @ self.gather[w - k :]
        return out, z


class Cascade:
    """Second-order sections one after the other; their states stand side by side."""

    def __init__(self, sos: np.ndarray, width: int = 64):
        self.sections, self.size = [_Section(row, width) for row in sos], 2 * len(sos)
        # The whole as one system, for the way of a state over many samples.
        a, c = np.zeros((0, 0)), np.zeros(0)
        for s in self.sections:
            a = np.block([[a, np.zeros((len(a), 2))], [np.outer(s.b, c), s.a]])
            c = np.concatenate((c * s.d, s.c))
        self.a = a

    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    def steady(self, level: float) -> np.ndarray:
        """The state in which a constant stays as it is."""
        out = []
        for s in self.sections:
            out.append(np.linalg.solve(np.eye(2) - s.a, s.b) * level)
            level = s.c @ out[-1] + s.d * level
        return np.concatenate(out)

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and final state."""
        ends = []
        for k, s in enumerate(self.sections):
            x, end = s.run(x, z[2 * k : 2 * k + 2])
            ends.append(end)
        return x, np.concatenate(ends)


def odd_extension(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after a signal: both ends turned by half a turn around their
    outermost sample, which is the first of ``head`` and the last of ``tail``."""
    return 2 * head[0] - head[:0:-1], 2 * tail[-1] - tail[-2::-1]


def padding(sections: int, n: int) -> int:
    if n < 32:
        raise ValueError("at least 32 samples are needed")
    return min(3 * (2 * sections + 1), n - 1)


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forward and backward, over an odd extension of both ends, each pass started in the
    steady state of its first value."""
    x, system = np.asarray(x, float), Cascade(sos)
    pad = padding(len(sos), len(x))
    before, after = odd_extension(x[: pad + 1], x[-pad - 1 :])
    wide = np.concatenate((before, x, after))
    for _ in range(2):
        wide = system.run(wide, system.steady(wide[0]))[0][::-1]
    return wide[pad:-pad]


def ratio_of(source: float, target: float) -> tuple[int, int]:
    """target / source as up / down."""
    ratio = Fraction(target / source).limit_denominator(10_000)
    return ratio.numerator, ratio.denominator


def reach(up: int, down: int) -> int:
    """Samples to either side that a resampled one depends on."""
    return -(-10 * max(up, down) // up) + 1


def resampled_part(x: np.ndarray, first: int, n: int, ends: tuple[float, float], up: int, down: int, start: int, stop: int) -> np.ndarray:
    """The samples [start, stop) of a signal of ``n`` samples at up / down times its rate, from
    its samples from ``first`` on, as far as they reach: a windowed sinc around every new sample,
    with the line through both ``ends`` of the signal taken out before and put back."""
    x = np.asarray(x, float)
    half = 10 * max(up, down)
    taps = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    slope = (ends[1] - ends[0]) / (n - 1) if n > 1 else 0.0
    flat = x - (ends[0] + slope * (first + np.arange(len(x))))
    out = np.empty(stop - start)
    wide = 2 * (half // up) + 2
    for at in range(start, stop, 1 << 14):
        t = np.arange(at, min(stop, at + (1 << 14)), dtype=np.int64) * down
        k = -(-(t - half) // up)[:, None] + np.arange(wide)  # old samples within reach
        far = half + t[:, None] - k * up
        fits = (far >= 0) & (k >= first) & (k < first + len(x)) & (far <= 2 * half)
        weight = np.where(fits, taps[np.clip(far, 0, 2 * half)], 0.0)
        line = ends[0] + slope * np.minimum(t / up, n - 1)
        out[at - start : at - start + len(t)] = (weight * flat[np.clip(k - first, 0, len(x) - 1)]).sum(axis=1) + line
    return out


def resample(x: np.ndarray, source: float, target: float) -> np.ndarray:
    """Rational-ratio resampling of a whole signal."""
    x, (up, down) = np.asarray(x, float), ratio_of(source, target)
    if up == down:
        return x.copy()
    return resampled_part(x, 0, len(x), (x[0], x[-1]), up, down, 0, -(-len(x) * up // down))


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Linear through non-finite samples, constant at the ends."""
    x = np.asarray(x, float)
    good = np.isfinite(x)
    if not good.any():
        raise ValueError("no finite sample")
    return np.interp(np.arange(len(x)), np.flatnonzero(good), x[good])


def robust_mad(x: np.ndarray) -> float:
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    mad = 1.4826 * float(np.median(np.abs(x - np.median(x)))) if len(x) else 0.0
    if not mad > 0:
        raise ValueError("no spread")
    return mad


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[width:] - total[:-width]


def correlate(signal: np.ndarray, template: np.ndarray, eligible: np.ndarray | None = None, step: int = 1):
    """Normalised cross-correlation: (starts, score, amplitude, whole window eligible).

    Overlapping blocks of some four templates are transformed together; a block gives the windows
    that lie in it whole, and its own running sums give their means and energies, so that
    rounding does not grow with the signal. Non-finite samples count as zero and are never
    eligible; flat windows score zero."""
    x, t = np.asarray(signal, float), np.asarray(template, float)
    shape_, w = t - t.mean(), len(t)
    power = float(shape_ @ shape_)
    if not power > 0 or len(x) < w or step < 1:
        raise ValueError("a template needs shape and room")
    good = np.isfinite(x)
    block = 1 << (4 * w - 1).bit_length()
    hop, windows = block - w + 1, len(x) - w + 1
    rows = -(-windows // hop)
    wide = np.zeros((rows - 1) * hop + block)
    wide[: len(x)] = np.where(good, x, 0.0)
    blocks = np.lib.stride_tricks.sliding_window_view(wide, block)[::hop]
    product = np.fft.irfft(np.fft.rfft(blocks) * np.conj(np.fft.rfft(shape_, block)), block)[:, :hop].ravel()[:windows]

    def sums(v: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros((rows, 1)), np.cumsum(v, axis=1)), axis=1)
        return (total[:, w:] - total[:, :-w]).ravel()[:windows]

    energy = np.maximum(sums(blocks * blocks) - sums(blocks) ** 2 / w, 0.0) * power
    seen = np.flatnonzero(energy > np.finfo(float).eps ** 2)
    score = np.zeros(windows)
    score[seen] = np.clip(product[seen] / np.sqrt(energy[seen]), -1.0, 1.0)
    ok = good if eligible is None else good & np.asarray(eligible, bool)
    at = np.arange(0, windows, step)
    return at, score[at], product[at] / power, (rolling(ok.astype(np.int64), w) == w)[at]


def local_maxima(score: np.ndarray, qualified: np.ndarray) -> np.ndarray:
    """Qualified places with no better qualified left and no equal or better right
    neighbour: the last of each plateau."""
    s = np.where(qualified, score, -np.inf)
    left, right = np.concatenate(([-np.inf], s[:-1])), np.concatenate((s[1:], [-np.inf]))
    return np.flatnonzero(qualified & (left <= s) & (right < s))


def suppress(center: np.ndarray, score: np.ndarray, amplitude: np.ndarray, scale: np.ndarray, radius: float) -> np.ndarray:
    """Greedy non-maximum suppression; indices of what stays, by centre. The best (score,
    size of amplitude, nearness of scale to 1) goes first, full ties in input order."""
    if radius < 0:
        raise ValueError("the radius is not negative")
    order = np.lexsort((np.arange(len(center)), np.abs(np.asarray(scale) - 1), -np.abs(amplitude), -np.asarray(score)))
    kept: list[int] = []
    cells: dict[int, list[float]] = {}
    width = radius if radius > 0 else 1.0
    for k in order.tolist():
        c = float(center[k])
        cell = math.floor(c / width)
        near = (o for n in (cell - 1, cell, cell + 1) for o in cells.get(n, ()))
        if all(abs(o - c) > radius for o in near):
            kept.append(k)
            cells.setdefault(cell, []).append(c)
    return np.array(sorted(kept, key=lambda k: (center[k], k)), np.int64)


def choose_anchors(eligible: np.ndarray, width: int, separation: int, most: int, rng: np.random.Generator, stride: int = 1) -> np.ndarray:
    """Starts of fully eligible windows, drawn in random order, ``separation`` apart."""
    if len(eligible) < width:
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(rolling(np.asarray(eligible, np.int64), width) == width)
    kept: list[int] = []
    for s in rng.permutation(starts[starts % stride == 0]).tolist():
        if len(kept) >= most:
            break
        if all(abs(s - k) >= separation for k in kept):
            kept.append(s)
    return np.array(sorted(kept), np.int64)
