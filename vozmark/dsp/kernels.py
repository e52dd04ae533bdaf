"""Numpy kernels over one utterance's samples."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .. import config as C


def scrub(x: np.ndarray, cap_s: float | None = C.CAP_SECONDS, least: int = 0) -> np.ndarray:
    """Capped, without NaN, padded with zeros to ``least`` samples."""
    x = np.nan_to_num(np.asarray(x, np.float32))
    if cap_s:
        x = x[: int(cap_s * C.SAMPLE_RATE)]
    return np.pad(x, (0, max(0, least - len(x))))


def spectral_moments(x: np.ndarray, rate: int = C.SAMPLE_RATE) -> np.ndarray:
    """Centroid, variance, skewness, excess kurtosis, peak (Hz), log band ratio within the band."""
    n = min(len(x), C.FFT_SIZE)
    if not n:
        return np.zeros(6, np.float32)
    power = np.abs(np.fft.rfft(np.asarray(x[:n], np.float64) * np.hanning(n), C.FFT_SIZE)) ** 2
    hz = np.fft.rfftfreq(C.FFT_SIZE, 1 / rate)
    within = lambda band: (hz >= band[0]) & (hz <= band[1])
    f, p = hz[within(C.BAND_HZ)], power[within(C.BAND_HZ)]
    total = p.sum()
    if total <= 0:
        return np.zeros(6, np.float32)
    p = p / total
    m1 = (f * p).sum()
    d = f - m1
    m2 = (d**2 * p).sum()
    sd = np.sqrt(max(m2, 1e-9))
    ratio = np.log10((power[within(C.HIGH_BAND_HZ)].sum() + 1e-12) / (power[within(C.LOW_BAND_HZ)].sum() + 1e-12))
    return np.array([m1, m2, (d**3 * p).sum() / sd**3, (d**4 * p).sum() / sd**4 - 3, f[p.argmax()], ratio], np.float32)


def _slaney(hz):
    hz = np.asarray(hz, np.float64)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def _slaney_hz(mel):
    mel = np.asarray(mel, np.float64)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(8)
def mel_bank(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """Triangles evenly spaced in mel, each of unit area."""
    edge = _slaney_hz(np.linspace(_slaney(0), _slaney(rate / 2), bands + 2))
    hz = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (hz - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - hz) / (edge[2:] - edge[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mfcc(x: np.ndarray, rate: int = C.SAMPLE_RATE, coefficients: int = 13, n_fft: int = 400, hop: int = 160) -> np.ndarray:
    """(coefficients, frames): centred power spectra, 128 mel bands, dB over a range of 80, DCT-II."""
    x = np.pad(np.asarray(x, np.float64), n_fft // 2)
    frames = 1 + (len(x) - n_fft) // hop
    at = np.arange(n_fft)[None, :] + hop * np.arange(max(1, frames))[:, None]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(x[np.minimum(at, len(x) - 1)] * hann)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_bank(rate, n_fft, 128).T, 1e-10))
    db = np.maximum(db, db.max() - 80)
    k, n = np.arange(coefficients)[:, None], np.arange(128)[None, :]
    dct = np.cos(np.pi * k * (2 * n + 1) / 256) * np.where(k == 0, np.sqrt(1 / 128), np.sqrt(2 / 128))
    return (dct @ db.T).astype(np.float32)


@lru_cache(2)
def _htk_bank(rate: int, size: int, bands: int) -> np.ndarray:
    mel = lambda f: 1127 * np.log(1 + np.asarray(f, np.float64) / 700)
    edge = np.linspace(mel(20), mel(rate / 2), bands + 2)
    m = mel(np.fft.rfftfreq(size, 1 / rate))
    up = (m - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - m) / (edge[2:] - edge[1:-1])[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def log_filterbank(x: np.ndarray, rate: int = C.SAMPLE_RATE, bands: int = 80) -> np.ndarray:
    """(frames, bands) log energies, 25 ms every 10 ms, no dither, edges mirrored."""
    size, hop = rate * 25 // 1000, rate * 10 // 1000
    x = np.asarray(x, np.float64)
    frames = (len(x) + hop // 2) // hop
    if not frames:
        return np.zeros((0, bands), np.float32)
    lead = size // 2 - hop // 2
    x = np.pad(x, (lead, size), mode="symmetric" if len(x) else "constant")
    f = x[np.arange(size)[None, :] + hop * np.arange(frames)[:, None]]
    f = f - f.mean(1, keepdims=True)
    f = f - 0.97 * np.concatenate([f[:, :1], f[:, :-1]], 1)
    f = f * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    power = np.abs(np.fft.rfft(f, 512)) ** 2
    return np.log(np.maximum(power @ _htk_bank(rate, 512, bands).T, np.finfo(np.float32).eps)).astype(np.float32)


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients by Burg's recursion."""
    f, b = np.array(x[1:], np.float64), np.array(x[:-1], np.float64)
    a = np.array([1.0])
    for _ in range(order):
        k = -2 * (f @ b) / max(f @ f + b @ b, 1e-12)
        a = np.append(a, 0) + k * np.append(a, 0)[::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def formants_at(x: np.ndarray, time_s: float, rate: int = C.SAMPLE_RATE, ceiling: float = 5000.0, count: int = 5) -> np.ndarray:
    """F1-F3 at a time: Burg prediction in 25 ms after pre-emphasis, resampled to twice the ceiling."""
    from ..sources.audio import resample

    half = int(0.025 * rate)
    mid = int(time_s * rate)
    part = np.asarray(x[max(0, mid - half) : mid + half], np.float64)
    out = np.full(3, np.nan)
    if len(part) < 64:
        return out
    low = resample(part, rate, int(2 * ceiling)).astype(np.float64)
    low = np.append(low[:1], low[1:] - np.exp(-2 * np.pi * 50 / (2 * ceiling)) * low[:-1])
    low = low * np.exp(-12 * ((np.arange(len(low)) + 0.5) / len(low) - 0.5) ** 2)
    if not np.any(low):
        return out
    roots = np.roots(burg(low, 2 * count))
    roots = roots[np.imag(roots) > 0]
    hz = np.sort(np.angle(roots) * ceiling / np.pi)
    hz = hz[(hz > 50) & (hz < ceiling - 50)][:3]
    out[: len(hz)] = hz
    return out


def pitch_at(x: np.ndarray, time_s: float, rate: int = C.SAMPLE_RATE, low: float = 75, high: float = 600) -> float:
    """F0 by the autocorrelation's peak over the window's own, NaN if unvoiced."""
    half, mid = int(1.5 * rate / low), int(time_s * rate)
    part = np.asarray(x[max(0, mid - half) : mid + half], np.float64)
    if len(part) < 2 * rate / low:
        return float("nan")
    part = part - part.mean()
    w = np.hanning(len(part))
    size = 1 << (2 * len(part) - 1).bit_length()
    corr = lambda y: np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2)[: len(part)]
    own, window = corr(part * w), corr(w)
    if own[0] <= 0:
        return float("nan")
    r = own / own[0] / np.maximum(window / window[0], 1e-3)
    a, b = int(rate / high), min(int(rate / low), len(r) - 1)
    k = a + int(r[a:b].argmax())
    return float(rate / k) if r[k] >= 0.45 else float("nan")
