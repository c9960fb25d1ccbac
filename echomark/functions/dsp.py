"""NumPy kernels on one clip."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

import numpy as np


def window(kind: str, n: int) -> np.ndarray:
    """Symmetric windows; a single point is 1."""
    if n == 1:
        return np.ones(1)
    x = np.cos(2 * np.pi * np.arange(n) / (n - 1))
    kinds = {"hamming": 0.54 - 0.46 * x, "hann": 0.5 - 0.5 * x, "rect": np.ones(n)}
    if kind not in kinds:
        raise ValueError(f"unknown window {kind!r}")
    return kinds[kind]


def resample(x: np.ndarray, fs_in: float, fs_out: float, crossings: int = 12, chunk: int = 1 << 16) -> np.ndarray:
    """Rational resampling by a tapered sinc whose weights sum to 1 for every output sample; ceil(n fs_out / fs_in) samples."""
    if fs_in <= 0 or fs_out <= 0:
        raise ValueError("sample rates must be positive")
    if fs_in == fs_out:
        return x.copy()
    ratio = Fraction(fs_out).limit_denominator(10**6) / Fraction(fs_in).limit_denominator(10**6)
    n = ceil(len(x) * ratio)
    cut = min(1.0, float(ratio))
    half = int(ceil(crossings / cut))
    out = np.empty(n)
    reach = np.arange(-half, half + 1)
    for lo in range(0, n, chunk):
        at = np.arange(lo, min(n, lo + chunk)) / float(ratio)
        base = np.floor(at).astype(np.int64)
        idx = base[:, None] + reach
        d = at[:, None] - idx
        w = cut * np.sinc(cut * d) * np.where(np.abs(d) <= half + 1, 0.54 + 0.46 * np.cos(np.pi * d / (half + 1)), 0)
        w /= w.sum(axis=1, keepdims=True)
        inside = (idx >= 0) & (idx < len(x))
        out[lo : lo + len(at)] = (w * np.where(inside, x[np.clip(idx, 0, max(len(x) - 1, 0))], 0)).sum(axis=1)
    return out


def level_dbfs(x: np.ndarray) -> float:
    rms = float(np.sqrt(np.mean(x * x))) if len(x) else 0.0
    return 20 * np.log10(rms) if rms > 0 else -np.inf


def rms_normalize(x: np.ndarray, target_dbfs: float) -> tuple[np.ndarray, float]:
    if not np.isfinite(x).all():
        raise ValueError("samples must be finite")
    now = level_dbfs(x)
    if now == -np.inf:
        return x, 0.0
    return x * 10 ** ((target_dbfs - now) / 20), target_dbfs - now


def preprocess(x: np.ndarray, cfg) -> np.ndarray:
    """DC removal, level, pre-emphasis."""
    if not np.isfinite(x).all():
        raise ValueError("samples must be finite")
    if cfg.pre.dc_remove and len(x):
        x = x - x.mean()
    x, _ = rms_normalize(x, cfg.audio.target_rms_dbfs)
    a = cfg.pre.preemph_alpha
    return np.concatenate([x[:1], x[1:] - a * x[:-1]]) if a else x


def stft(x: np.ndarray, win_len: int, hop: int, nfft: int, kind: str = "hamming") -> np.ndarray:
    """Complex one-sided transform, bins by frames, unscaled."""
    if nfft < win_len:
        raise ValueError("nfft must not be below the window length")
    n = (len(x) - win_len) // hop + 1 if len(x) >= win_len else 0
    if not n:
        return np.zeros((nfft // 2 + 1, 0), complex)
    framed = np.lib.stride_tricks.sliding_window_view(x, win_len)[: (n - 1) * hop + 1 : hop]
    return np.fft.rfft(framed * window(kind, win_len), nfft, axis=1).T


def noise_spectrum(mag: np.ndarray, frac: float) -> np.ndarray:
    mag, n = np.abs(mag), mag.shape[1]
    k = int(min(max(np.floor(frac * n + 0.5), 1), n))
    return mag[:, np.argsort((mag * mag).sum(axis=0), kind="stable")[:k]].mean(axis=1)


def spectral_subtract(spectrum: np.ndarray, noise: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    if len(noise) != spectrum.shape[0]:
        raise ValueError("one noise value per bin is needed")
    mag = np.abs(spectrum)
    return np.maximum(mag - alpha * noise[:, None], beta * mag)


def spectrogram(x: np.ndarray, fs: int, cfg, denoise: bool) -> np.ndarray:
    x = preprocess(resample(x, fs, cfg.audio.fs), cfg)
    mag = np.abs(stft(x, cfg.stft.win_len, cfg.stft.hop, cfg.stft.nfft, cfg.stft.window))
    return spectral_subtract(mag, noise_spectrum(mag, cfg.denoise.noise_frame_frac), cfg.denoise.alpha, cfg.denoise.beta) if denoise and mag.size else mag


def _moving(a: np.ndarray, n: int, axis: int, what, fill: float) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (n // 2, n // 2)
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=fill), n, axis=axis)
    return what(view, axis=-1)


def window_max(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    """The centred moving maximum over n places (odd) of an axis, shrinking at the edges, by windows that double."""
    pad = [(0, 0), (0, 0)]
    pad[axis] = (n // 2, n // 2)
    out, width = np.pad(a, pad, constant_values=-np.inf), 1
    while width < n:
        step = min(width, n - width)
        out = np.maximum(out[:-step], out[step:]) if axis == 0 else np.maximum(out[:, :-step], out[:, step:])
        width += step
    return out


def peaks(mag: np.ndarray, cfg) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, f, level) of the capped peaks of a magnitude matrix, in order of (t, f), all counted from 1."""
    p = cfg.peaks
    if not mag.size or mag.max() <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)
    db = 20 * np.log10(mag / mag.max() + np.finfo(float).eps)
    top = window_max(window_max(mag, p.nbhd_f, 0), p.nbhd_t, 1)
    ok = (mag >= top) & (mag > 0)
    if p.mode == "fixed":
        ok &= db >= p.floor_db
    elif p.mode == "adaptive":
        ok &= db >= _moving(_moving(db, p.nbhd_f, 0, np.nanmedian, np.nan), p.nbhd_t, 1, np.nanmedian, np.nan) + p.kappa_db
    else:
        raise ValueError(f"unknown peak mode {p.mode!r}")
    t, f = np.nonzero(ok.T)
    level = db[f, t].astype(np.float32)
    t, f = t + 1, f + 1
    edges = np.array(p.band_edges_hz, float)
    band = np.clip(np.searchsorted(edges, (f - 1) * cfg.bin_width_hz, "right") - 1, 0, len(edges) - 2)
    sec = np.floor((t - 1) / cfg.frame_rate).astype(np.int64)
    order = np.lexsort((f, t, -level, band, sec))
    group = sec[order] * len(edges) + band[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1]) if len(group) else np.zeros(0, np.int64)
    k = max(1, int(p.density_per_sec / (len(edges) - 1) + 0.5))
    place = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    kept = np.sort(order[place < k])
    return t[kept], f[kept], level[kept]


def mix_at_snr(x: np.ndarray, noise: np.ndarray, snr_db: float) -> tuple[np.ndarray, float, float]:
    """(mixture, measured SNR, gain). +inf or silent noise leaves the signal; a silent signal gives the noise at gain 1 and -inf."""
    if np.isnan(snr_db):
        raise ValueError("the SNR must be a number")
    noise = np.resize(noise, len(x)) if len(noise) else np.zeros(len(x))
    px, pn = np.mean(x * x), np.mean(noise * noise)
    if snr_db == np.inf or pn == 0:
        return x, np.inf, 0.0
    gain = 1.0 if px == 0 else float(np.sqrt(px / (pn * 10 ** (snr_db / 10))))
    measured = -np.inf if px == 0 else 10 * np.log10(px / np.mean((gain * noise) ** 2))
    y = x + gain * noise
    top = np.abs(y).max()
    return (y * 0.99 / top if top > 0.99 else y), measured, gain


def synthesize(song: np.ndarray, start: int, n: int, noise: np.ndarray | None, noise_start: int, snr_db: float) -> tuple[np.ndarray, float]:
    """The excerpt of n samples from `start` (from 1), mixed with noise from noise_start on, wrapping past its end."""
    if start < 1 or start - 1 + n > len(song):
        raise ValueError("the excerpt leaves the song")
    x = song[start - 1 : start - 1 + n]
    if noise is None or snr_db == np.inf:
        return x, np.inf
    v = noise[(max(noise_start, 1) - 1 + np.arange(n)) % len(noise)]
    y, measured, _ = mix_at_snr(x, v, snr_db)
    return y, measured


def moving_max(x: np.ndarray, n: int) -> np.ndarray:
    """The centred moving maximum over n columns, shrinking at the edges, in a time that does not depend on n: in blocks of n columns a window is the end of one block and the beginning of the next, so running maxima from both ends suffice."""
    rows, m = x.shape
    r = n // 2
    padded = np.full((rows, -(-(m + 2 * r) // n) * n), -np.inf)
    padded[:, r : r + m] = x
    blocks = padded.reshape(rows, -1, n)
    ahead = np.maximum.accumulate(blocks, axis=2).reshape(rows, -1)
    back = np.maximum.accumulate(blocks[:, :, ::-1], axis=2)[:, :, ::-1].reshape(rows, -1)
    return np.maximum(back[:, :m], ahead[:, n - 1 : n - 1 + m])


def moving_median(x: np.ndarray, n: int) -> np.ndarray:
    """The centred moving median over n columns, shrinking at the edges; cells that are not finite are absent, and without any the median is NaN.

    A sorted window for each row moves along: the value that leaves is taken out and the one that enters is put in, all rows at once.
    """
    rows, m = x.shape
    r, at = n // 2, np.arange(n)
    x = np.where(np.isfinite(x), x, np.inf)
    window, held = np.full((rows, n), np.inf), np.zeros(rows, np.int64)
    out, every = np.empty((rows, m)), np.arange(rows)
    for k in range(-r, m):
        if k - r - 1 >= 0:
            old = x[:, k - r - 1]
            gone = (window < old[:, None]).sum(axis=1)
            held -= np.isfinite(old)
            window = np.where(at >= gone[:, None], np.pad(window[:, 1:], ((0, 0), (0, 1)), constant_values=np.inf), window)
        if k + r < m:
            new = x[:, k + r]
            place = (window < new[:, None]).sum(axis=1)
            held += np.isfinite(new)
            shifted = np.pad(window[:, :-1], ((0, 0), (1, 0)), constant_values=np.inf)
            window = np.where(at < place[:, None], window, np.where(at == place[:, None], new[:, None], shifted))
        if k >= 0:
            low, high = window[every, np.maximum(held - 1, 0) // 2], window[every, np.minimum(held // 2, n - 1)]
            with np.errstate(invalid="ignore"):
                out[:, k] = np.where(held > 0, (low + high) / 2, np.nan)
    return out
