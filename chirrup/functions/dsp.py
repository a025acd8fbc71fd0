"""Numpy kernels for one waveform, and the Arrow functions that run them on columns."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 16000
WAVE = T.ArrayType(T.FloatType())
#: Energy or power up to which a signal counts as silent.
SILENT = 1e-12


_KEPT: dict = {}


def kept(build, *settings):
    """Filters depend on settings alone: each task builds them once."""
    key = (build.__name__, *settings)
    if key not in _KEPT:
        _KEPT[key] = build(*settings)
    return _KEPT[key]


def as_wave(x) -> np.ndarray:
    return np.asarray(x, dtype=np.float64)


def lowpass(up: int, down: int) -> np.ndarray:
    """Kaiser-windowed sinc for a rate change by up/down: cut at the lower Nyquist rate, gain `up`."""
    widest = max(up, down)
    half = 10 * widest
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / widest) * np.kaiser(2 * half + 1, 5.0)
    return taps * (up / taps.sum())


def phase_bank(up: int, down: int) -> np.ndarray:
    """The low-pass taps by output phase: one row per phase, newest input first."""
    taps = lowpass(up, down)
    per_phase = -(-len(taps) // up)
    return np.pad(taps, (0, per_phase * up - len(taps))).reshape(per_phase, up).T.copy()


def resample(x: np.ndarray, rate: int, target: int, block: int = 65536) -> np.ndarray:
    """Polyphase rate change; ceil(n * up / down) samples come out."""
    if rate == target:
        return x
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    bank = kept(phase_bank, up, down)
    per_phase = bank.shape[1]
    half = 10 * max(up, down)
    n_out = -(-len(x) * up // down)
    reach = half // up + 1
    padded = np.concatenate([np.zeros(per_phase + reach), x, np.zeros(per_phase + reach + 1)])
    out = np.empty(n_out)
    lags = np.arange(per_phase)
    for at in range(0, n_out, block):
        # Output m sits at tap offset m*down + half of the zero-stuffed input.
        position = np.arange(at, min(at + block, n_out)) * down + half
        rows = (position // up)[:, None] - lags + per_phase + reach
        out[at : at + block] = np.einsum("ij,ij->i", padded[rows], bank[position % up])
    return out


def frame_rms(x: np.ndarray, frame: int = 320, hop: int = 160) -> np.ndarray:
    """RMS of every whole frame; a signal shorter than one frame is zero-padded to it."""
    if len(x) < frame:
        x = np.pad(x, (0, frame - len(x)))
    starts = np.arange(0, len(x) - frame + 1, hop)
    squares = np.square(x)
    if frame % hop == 0:
        # Frames share hop-sized pieces: sum each piece once.
        pieces = squares[: (len(squares) // hop) * hop].reshape(-1, hop).sum(axis=1)
        k = frame // hop
        sums = sum(pieces[i : i + len(starts)] for i in range(k))
    else:
        sums = np.array([squares[s : s + frame].sum() for s in starts])
    return np.sqrt(sums / frame)


def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters [n_mels, bins], evenly spaced on the HTK mel scale, not normalised."""
    top = 2595.0 * math.log10(1.0 + (rate / 2) / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, top, n_mels + 2) / 2595.0) - 1.0)
    bins = np.linspace(0.0, rate // 2, n_fft // 2 + 1)
    rise = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall))


def frame_window(n_fft: int, win: int) -> np.ndarray:
    """A periodic Hann window centred in the transform's frame."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    left = (n_fft - win) // 2
    return np.pad(hann, (left, n_fft - win - left))


def log_mel_matrix(x, rate=RATE, n_fft=512, win=480, hop=160, n_mels=40, power=2.0, eps=1e-6) -> np.ndarray:
    """Log-mel features [n_mels, 1 + n // hop] of centred, reflect-padded Hann frames."""
    x = np.pad(as_wave(x), n_fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    spectrum = np.abs(np.fft.rfft(frames * kept(frame_window, n_fft, win), axis=1)) ** power
    return np.log(kept(mel_bank, rate, n_fft, n_mels) @ spectrum.T + eps)


def stacked(waves) -> tuple[np.ndarray, np.ndarray]:
    """Signals of any lengths as the rows of one zero-filled matrix, and where it holds samples."""
    rows = [as_wave(x) for x in waves]
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    held = np.arange(sizes.max(initial=1)) < sizes[:, None]
    out = np.zeros(held.shape)
    out[held] = np.concatenate([np.zeros(0), *rows])
    return out, held


def row_energy(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def within_scale(x: np.ndarray) -> np.ndarray:
    """Rows that pass full scale, brought down to it."""
    return x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1.0)


def echo_rows(x: np.ndarray, held: np.ndarray, kernels) -> np.ndarray:
    """Each row convolved with its kernel, as long and as loud as before and within full scale; silent rows stay."""
    h, _ = stacked(kernels)
    n = x.shape[1]
    m = 2 ** math.ceil(math.log2(n + h.shape[1]))
    spectra = np.fft.rfft(x, m) * np.fft.rfft(h, m)
    wet = np.where(held, np.fft.irfft(spectra, m)[:, :n], 0.0)
    before = row_energy(x)
    gain = np.sqrt(before / np.maximum(row_energy(wet), SILENT))
    return np.where((before > SILENT)[:, None], within_scale(wet * gain[:, None]), x)


def mix_rows(x: np.ndarray, held: np.ndarray, noises, draws, snr_db) -> np.ndarray:
    """Each row with its noise at a signal-to-noise ratio, within full scale; silent rows and silent noises change nothing.

    A noise longer than the row is cut at a random place; a shorter one repeats
    from a random place on.  `draws` are uniform in [0, 1).
    """
    sizes = held.sum(axis=1)
    noise = np.zeros_like(x)
    for row, z, u, n in zip(noise, map(as_wave, noises), draws, sizes):
        places = len(z) - n + 1 if len(z) >= n else len(z)
        row[:n] = np.resize(np.roll(z, -int(u * places)), n)
    signal, hum = row_energy(x) / np.maximum(sizes, 1), row_energy(noise) / np.maximum(sizes, 1)
    level = np.sqrt(signal / np.maximum(hum, SILENT)) * 10.0 ** (-np.asarray(snr_db, np.float64) / 20)
    mixed = within_scale(x + noise * level[:, None])
    return np.where((np.minimum(signal, hum) > SILENT)[:, None], mixed, x)


def to_pcm16(x) -> bytes:
    """Little-endian 16-bit samples, halves rounded to even."""
    return np.rint(np.clip(as_wave(x), -1.0, 1.0) * 32767).astype("<i2").tobytes()


def _series(f, returns):
    """A pandas UDF that applies `f` to each row's values.

    Marked nondeterministic so that the optimizer never evaluates it a second
    time for a filter on its result.
    """

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    return F.pandas_udf(run, returns).asNondeterministic()


def resampled(samples: Column, rate: Column, target: int = RATE) -> Column:
    return _series(lambda x, r: resample(as_wave(x), int(r), target).astype(np.float32), WAVE)(samples, rate)


def speed_changed(samples: Column, rate_percent: Column) -> Column:
    """Play at rate_percent/100 of the speed: ceil(n * 100 / rate) samples."""
    return _series(lambda x, r: resample(as_wave(x), int(r), 100).astype(np.float32), WAVE)(samples, rate_percent)


def rms_frames(samples: Column, frame: int = 320, hop: int = 160) -> Column:
    return _series(lambda x: frame_rms(as_wave(x), frame, hop), T.ArrayType(T.DoubleType()))(samples)


def log_mel(samples: Column, rate: int = RATE, **settings) -> Column:
    return _series(lambda x: list(log_mel_matrix(x, rate, **settings)), T.ArrayType(T.ArrayType(T.DoubleType())))(samples)


def by_block(f, returns, rows: int = 64):
    """A pandas UDF that gives `f` blocks of rows to work on together; rows with a null give null."""

    def run(*columns: pd.Series) -> pd.Series:
        out = np.empty(len(columns[0]), dtype=object)
        whole = np.flatnonzero(np.logical_and.reduce([c.notna().to_numpy() for c in columns]))
        for at in range(0, len(whole), rows):
            part = whole[at : at + rows]
            for i, y in zip(part, f(*(c.iloc[part] for c in columns))):
                out[i] = y
        return pd.Series(out)

    return F.pandas_udf(run, returns).asNondeterministic()


def reverbed(samples: Column, kernel: Column) -> Column:
    def f(waves, kernels):
        x, held = stacked(waves)
        return [y[h] for y, h in zip(echo_rows(x, held, kernels), held)]

    return by_block(f, T.ArrayType(T.DoubleType()))(samples, kernel)


def noised(samples: Column, noise: Column, draw: Column, snr_db: Column) -> Column:
    def f(waves, noises, draws, snr):
        x, held = stacked(waves)
        return [y[h] for y, h in zip(mix_rows(x, held, noises, draws, snr), held)]

    return by_block(f, T.ArrayType(T.DoubleType()))(samples, noise, draw, snr_db)


def pcm16(samples: Column) -> Column:
    return _series(to_pcm16, T.BinaryType())(samples)


def pcm16_content_hash(samples: Column) -> Column:
    """sha256 of the 16-bit samples, so that a changed file header cannot hide a duplicate."""
    return _series(lambda x: hashlib.sha256(to_pcm16(x)).hexdigest(), T.StringType())(samples)
