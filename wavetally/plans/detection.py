"""From signals to candidates (by frames) and injection scores (a recording per grouped call)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavetally.functions import signals, waveforms
from wavetally.operators import filtering, sequences, suppression
from wavetally.plans.bootstrap import labelled_seed

CANDIDATES = "record_id string, code_id string, start_sample long, end_sample long, center_sample double, time_scale double, score double, signed_score double, fitted_amplitude double, amplitude_mad double, polarity int"
SCORES = "record_id string, code_id string, anchor_index int, anchor_sample long, matched_score double, matched_start long, matched_scale double, local_mad double, status string"


@dataclass(frozen=True)
class Detector:
    floor: float = 0.0
    least_amplitude: float = 0.0
    step: int = 5
    radius: float = 100.0
    rate: float = 100.0
    bin_seconds: float = 30.0
    window_seconds: float = 300.0
    least_seconds: float = 30.0


def scan(signal: np.ndarray, bank: dict[float, np.ndarray], d: Detector, eligible: np.ndarray, scale: float | None) -> list[tuple]:
    """Local maxima of every template, (start, end, centre, template scale, score, signed,
    amplitude, amplitude in units of ``scale``, polarity). Without ``scale`` no gate."""
    out = []
    for s, t in bank.items():
        if len(signal) < len(t):
            continue
        at, signed, amp, ok = signals.correlate(signal, t, eligible, d.step)
        unit = 1.0 if scale is None else scale
        good = ok & (np.abs(signed) >= d.floor) & (scale is None or np.abs(amp) / unit >= d.least_amplitude)
        for k in signals.local_maxima(np.abs(signed), good).tolist():
            a = int(at[k])
            out.append((a, a + len(t), a + (len(t) - 1) / 2, s, abs(signed[k]), signed[k], amp[k], abs(amp[k]) / unit, int(np.sign(signed[k])) or 1))
    return out


def trailing_scale(signal: np.ndarray, invalid: np.ndarray, sample: int, d: Detector, first: int = 0) -> float | None:
    """Robust scale of the valid samples before the sample's bin; None without enough. ``first``:
    the number of the signal's first sample."""
    stop = int(sample // (d.bin_seconds * d.rate) * d.bin_seconds * d.rate) - first
    part = slice(max(0, stop - int(d.window_seconds * d.rate)), max(0, stop))
    x = signal[part][~invalid[part]]
    if len(x) < d.least_seconds * d.rate:
        return None
    try:
        return signals.robust_mad(x)
    except ValueError:
        return None


def _signal(rows: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.asarray(v, float) for v in rows.sort_values("chunk_idx")["values"]])


def filtered_bank(rhythm: str, w: waveforms.Waveform, scales: tuple[float, ...], sos: np.ndarray, pad_seconds: float = 30.0) -> dict[float, np.ndarray]:
    pad = int(pad_seconds * w.rate)
    out = {}
    for s, t in waveforms.template_bank(rhythm, w, scales).items():
        out[s] = signals.zero_phase(np.concatenate((np.zeros(pad), t, np.zeros(pad))), sos)[pad:-pad]
    return out


def _mask(ranges, n: int, first: int = 0) -> np.ndarray:
    m = np.zeros(n, bool)
    for r in ranges if ranges is not None else ():
        m[max(0, int(r["start"]) - first) : max(0, int(r["stop"]) - first)] = True
    return m


def _with_intervals(chunks: DataFrame, intervals: DataFrame) -> DataFrame:
    """Joins each recording's intervals to its first chunk only."""
    per = intervals.groupBy("record_id").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("start", "stop"))).alias(k) for k in ("eligible", "invalid")])
    return chunks.join(per.withColumn("chunk_idx", F.lit(0)), ["record_id", "chunk_idx"], "left")


MAXIMA = CANDIDATES.replace("amplitude_mad double", "local_mad double")


def maxima(frames: DataFrame, banks: dict[str, dict[float, np.ndarray]], d: Detector, size: int) -> DataFrame:
    """Local maxima of every template that start in a frame's own samples, with the causal scale
    before them (null without enough samples). frames: as ``filtering.frames`` gives them, with
    ``eligible`` and ``invalid`` (arrays of start and stop) beside."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x, first = np.asarray(r.values, float), int(r.first_sample)
                invalid = _mask(r.invalid, len(x), first)
                eligible = _mask(r.eligible, len(x), first) & ~invalid
                own = (r.frame * size, (r.frame + 1) * size)
                low = -(-max(own[0] - d.step, first) // d.step) * d.step - first  # on the grid of the recording
                scales: dict[int, float | None] = {}
                for code, bank in banks.items():
                    for m in scan(x[low:], bank, d, eligible[low:], None):
                        at = m[0] + low + first
                        if own[0] <= at < own[1]:
                            cell = int(at // (d.bin_seconds * d.rate))
                            if cell not in scales:
                                scales[cell] = trailing_scale(x, invalid, at, d, first)
                            out.append((r.record_id, code, at, m[1] + low + first, m[2] + low + first, *m[3:7], scales[cell], m[8]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MAXIMA.split(", ")]).astype({"local_mad": float})

    return frames.mapInPandas(of, MAXIMA)


def candidates(chunks: DataFrame, intervals: DataFrame, banks: dict[str, dict[float, np.ndarray]], sos: np.ndarray, d: Detector, size: int = 60_000) -> DataFrame:
    """chunks of one channel; intervals: record_id, kind (eligible, invalid), start, stop.

    Gaps are filled and the whole recording is filtered chunk by chunk; then frames of ``size``
    samples, with as many before as the scale needs and after as a template, are scanned apart.
    One candidate for each centre, then the causal amplitude gate, then suppression in rounds.
    No task holds a recording, and any cut into chunks or frames gives the same."""
    longest = max(len(t) for bank in banks.values() for t in bank.values())
    before, after = int((d.window_seconds + d.bin_seconds) * d.rate) + d.step, longest + d.step
    whole = filtering.zero_phase(filtering.filled(chunks).drop("lost"), sos)
    framed = filtering.frames(whole, size, before, after)
    near = intervals.where("start < stop").withColumn("frame", F.explode(F.sequence(F.floor((F.col("start") - after) / size), F.floor((F.col("stop") - 1 + before) / size))))
    per = near.groupBy("record_id", "frame").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("start", "stop"))).alias(k) for k in ("eligible", "invalid")])
    found = maxima(framed.join(per, ["record_id", "frame"], "left"), banks, d, size)
    better = [-F.col("score"), -F.abs("fitted_amplitude"), F.abs(F.col("time_scale") - 1), F.col("time_scale"), F.col("start_sample")]
    one = sequences.best_per_center(found, ["record_id", "code_id"], "center_sample", [b.asc() for b in better])
    gated = one.withColumn("amplitude_mad", F.abs("fitted_amplitude") / F.col("local_mad")).where((F.col("local_mad") > 0) & (F.col("amplitude_mad") >= d.least_amplitude))
    return suppression.suppress(gated.select(*[c.split()[0] for c in CANDIDATES.split(", ")]), ["record_id", "code_id"], d.radius, "center_sample", better)


GRID = "record_id string, code_id string, anchor_index int, anchor_sample long, amplitude_mad double, interval_jitter_fraction double, injection_samples long, matched_score double, matched_start long, matched_scale double, local_mad double"


def _best_near(y: np.ndarray, offset: int, bank: dict[float, np.ndarray], d: Detector, eligible: np.ndarray, scale: float, anchor: int, tolerance: float) -> tuple:
    """(score, start, template scale) of the best candidate that starts near the anchor; the
    first sample of ``y`` and ``eligible`` is ``offset``."""
    near = [r for r in scan(y, bank, d, eligible, scale) if abs(r[0] + offset - anchor) <= tolerance * d.rate]
    best = max(near, key=lambda r: (r[4], -r[0])) if near else None
    return (best[4], best[0] + offset, best[3]) if best else (0.0, None, None)


def injection_grid(chunks: DataFrame, intervals: DataFrame, rhythms: dict[str, str], w: waveforms.Waveform, banks: dict[str, dict[float, np.ndarray]], sos: np.ndarray, d: Detector, p: waveforms.Perturbation, amplitudes: list[float], jitters: list[float], seed: int, most: int = 20, separation: int = 3000, context: float = 1.5, tolerance: float = 0.75) -> DataFrame:
    """Every code x jitter x amplitude at the same anchors of a recording.

    A condition puts all its copies into one signal, which is filtered whole; its draws have a
    seed of record, code, amplitude and jitter. Anchors with too little signal before them are
    left out; a recording without any anchor raises."""
    width = waveforms.longest_injection(list(rhythms.values()), w, max(jitters), p.transition[1])
    grid = list(product(rhythms.items(), jitters, amplitudes))

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        raw = signals.fill_gaps(_signal(rows))
        first = rows.sort_values("chunk_idx").iloc[0]
        record, invalid = first["record_id"], _mask(first["invalid"], len(raw))
        eligible = _mask(first["eligible"], len(raw)) & ~invalid
        x = signals.zero_phase(raw, sos)
        drawn = signals.choose_anchors(eligible, width, separation, most, np.random.default_rng(labelled_seed(seed, record, "anchors")), stride=round(d.rate))
        places = [(i, a, mad) for i, a in enumerate(drawn.tolist()) if (mad := trailing_scale(x, invalid, a, d))]
        if not places:
            raise ValueError(f"{record}: no anchor")
        out, around = [], int(context * d.rate)
        for (code, rhythm), jitter, amplitude in grid:
            rng, added = np.random.default_rng(labelled_seed(seed, record, code, amplitude, jitter)), np.zeros(len(raw))
            waves = [waveforms.perturbed(rhythm, w, amplitude * mad, rng, replace(p, jitter=jitter)) for _, _, mad in places]
            for (_, a, _), wave in zip(places, waves, strict=True):
                added[a : a + len(wave)] += wave
            y = signals.zero_phase(raw + added, sos)
            for (i, a, mad), wave in zip(places, waves, strict=True):
                part = slice(max(0, a - around), min(len(raw), a + width + around))
                best = _best_near(y[part], part.start, banks[code], d, eligible[part], mad, a, tolerance)
                out.append((record, code, i, a, amplitude, jitter, len(wave), *best, mad))
        return pd.DataFrame(out, columns=[c.split()[0] for c in GRID.split(", ")])

    return _with_intervals(chunks, intervals).groupBy("record_id").applyInPandas(of, GRID)


def injections(chunks: DataFrame, intervals: DataFrame, rhythms: dict[str, str], w: waveforms.Waveform, banks: dict[str, dict[float, np.ndarray]], sos: np.ndarray, d: Detector, p: waveforms.Perturbation, amplitude: float, seed: int, most: int = 20, separation: int = 3000, context: float = 1.5, tolerance: float = 0.75) -> DataFrame:
    """Scores of synthetic copies added to the raw signal at shared anchors; both codes use
    one seed per anchor. Anchors without enough signal before them have a status."""
    width = waveforms.longest_injection(list(rhythms.values()), w, p.jitter, p.transition[1])

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        raw = signals.fill_gaps(_signal(rows))
        first = rows.sort_values("chunk_idx").iloc[0]
        record = first["record_id"]
        invalid = _mask(first["invalid"], len(raw))
        eligible = _mask(first["eligible"], len(raw)) & ~invalid
        x = signals.zero_phase(raw, sos)
        anchors = signals.choose_anchors(eligible, width, separation, most, np.random.default_rng(labelled_seed(seed, record)))
        out = []
        for i, a in enumerate(anchors.tolist()):
            scale = trailing_scale(x, invalid, a, d)
            for code, rhythm in rhythms.items():
                if scale is None:
                    out.append((record, code, i, a, 0.0, None, None, None, "too little signal before"))
                    continue
                wave = waveforms.perturbed(rhythm, w, amplitude * scale, np.random.default_rng(labelled_seed(seed, record, i)), p)
                lo, hi = max(0, a - int(context * d.rate)), min(len(raw), a + width + int(context * d.rate))
                far_lo, far_hi = max(0, lo - int(30 * d.rate)), min(len(raw), hi + int(30 * d.rate))
                y = raw[far_lo:far_hi].copy()
                y[a - far_lo : a - far_lo + len(wave)] += wave[: len(y) - (a - far_lo)]
                y = signals.zero_phase(y, sos)[lo - far_lo : hi - far_lo]
                out.append((record, code, i, a, *_best_near(y, lo, banks[code], d, np.ones(len(y), bool), scale, a, tolerance), scale, "ok"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCORES.split(", ")])

    return _with_intervals(chunks, intervals).groupBy("record_id").applyInPandas(of, SCORES)
