"""Alignment of one whole film in memory, as the operators are compared with."""

import numpy as np

from cuewright.operators.signals import COARSE, FINE, LEAST_DENSITY, LEAST_OVERLAP, LEAST_SCORE, LOUD, QUIET, WINDOW_SEARCH, frame_rates


def _bins(start: np.ndarray, end: np.ndarray, count: int, width: float) -> np.ndarray:
    """0/1 vector of intervals, by adding up where they begin and end."""
    first = np.floor(np.maximum(start, 0) / width).astype(np.int64)
    last = np.maximum(np.ceil(np.maximum(end, 0) / width).astype(np.int64), first + 1)
    keep = first < count
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, first[keep], 1)
    np.add.at(edge, np.minimum(last[keep], count), -1)
    return (np.cumsum(edge[:-1]) > 0).astype(np.float64)


def _size(audio: np.ndarray, cues: np.ndarray) -> int:
    return 1 << int(len(audio) + len(cues) - 1).bit_length()


def lag_scores(audio: np.ndarray, cues: np.ndarray, span: int, heard: np.ndarray | None = None) -> np.ndarray:
    """Pearson's r at each lag from -span to span; the overlap counts of all lags by one transform.

    ``heard``: the conjugate transform of ``audio``, where it is at hand.
    """
    size = _size(audio, cues)
    heard = np.conj(np.fft.rfft(audio, size)) if heard is None else heard
    product = np.fft.irfft(np.fft.rfft(cues, size) * heard, size)
    lags = np.arange(-span, span + 1)
    both = np.where(np.abs(lags) < max(len(audio), len(cues)), np.rint(product[lags % size]), 0.0)
    fa, la = np.flatnonzero(audio)[[0, -1]]
    fc, lc = np.flatnonzero(cues)[[0, -1]]
    lo, hi = np.maximum(fc, fa + lags), np.minimum(lc, la + lags) + 1
    n = np.maximum(hi - lo, 0).astype(np.float64)
    ok = n >= LEAST_OVERLAP
    ca, cc = np.concatenate([[0], np.cumsum(audio)]), np.concatenate([[0], np.cumsum(cues)])
    lo, hi, shift = np.where(ok, lo, fc), np.where(ok, hi, fc), np.where(ok, lags, 0)
    sc = cc[hi] - cc[lo]
    sa = ca[np.clip(hi - shift, 0, len(audio))] - ca[np.clip(lo - shift, 0, len(audio))]
    ok &= (sa > 0) & (sc > 0) & (sa < n) & (sc < n)
    below = np.sqrt(np.where(ok, n * sa - sa * sa, 1)) * np.sqrt(np.where(ok, n * sc - sc * sc, 1))
    return np.where(ok, (n * both - sa * sc) / below, 0.0)


def _content(x: np.ndarray) -> float:
    on = np.flatnonzero(x)
    return len(on) / (on[-1] - on[0] + 1) if len(on) else 0.0


def best_lag(audio: np.ndarray, cues: np.ndarray, width: float, most: float, heard: np.ndarray | None = None) -> tuple[float, float] | None:
    """(lag in seconds, score) of the best lag, or nothing if a signal has no shape or no score is positive."""
    if not audio.any() or not cues.any() or _content(audio) > LOUD or _content(cues) > LOUD:
        return None
    span = round(max(most, 0) / width)
    if span < 1:
        return None
    scores = lag_scores(audio, cues, span, heard)
    k = int(np.argmax(scores))
    return ((k - span) * width, float(scores[k])) if scores[k] > 0 else None


def measure(speech: np.ndarray, cues: np.ndarray, runtime: float, windows: int = 12, most: float = 120.0, rates: bool = True) -> dict:
    """Alignment of one track's cues with the speech of its film: rows (start, end) in seconds, in order."""
    nothing = {"score": 0.0, "offset_s": 0.0, "scale": 1.0, "anchors": []}
    if not len(speech):
        return nothing | {"failure": "no speech was found in the audio track"}
    if not len(cues):
        return nothing | {"failure": "the track holds no dialogue to align"}
    duration = max(runtime or 0.0, speech[-1, 1], cues[-1, 1] + most)
    count = int(np.ceil(duration / COARSE))
    audio = _bins(speech[:, 0], speech[:, 1], count, COARSE)
    if not QUIET < _content(audio) < LOUD:
        return nothing | {"failure": "the audio is almost all speech or almost all silence"}
    if _content(_bins(cues[:, 0], cues[:, 1], count, COARSE)) < LEAST_DENSITY:
        return nothing | {"failure": "the track is too sparse to align"}
    best, heard = (0.0, 0.0, 1.0), np.conj(np.fft.rfft(audio, _size(audio, audio)))  # once for all scales
    for scale in [1.0, *(p[3] for p in frame_rates())] if rates else [1.0]:
        found = best_lag(audio, _bins(cues[:, 0] / scale, cues[:, 1] / scale, count, COARSE), COARSE, most, heard)
        if found and found[1] > best[0]:
            best = (found[1], found[0] * scale, scale)
    score, offset, scale = best
    out = {"score": score, "offset_s": offset, "scale": scale, "anchors": [], "failure": None}
    if score < LEAST_SCORE:
        return out
    fine = int(np.ceil(duration / FINE))
    audio = _bins(speech[:, 0], speech[:, 1], fine, FINE)
    moved = _bins((cues[:, 0] - offset) / scale, (cues[:, 1] - offset) / scale, fine, FINE)
    n = min(max(windows, 2), 64)
    length = duration / n
    for i in range(n):
        a, b = int(np.floor(i * length / FINE)), min(int(np.ceil((i * length + length) / FINE)), fine)
        found = best_lag(audio[a:b], moved[a:b], FINE, WINDOW_SEARCH)
        strength = min(max((found[1] - 0.15) / 0.40, 0.0), 1.0) if found else 0.0
        if strength > 0:
            centre = i * length + length / 2
            out["anchors"].append((centre, offset + (scale - 1.0) * centre + scale * found[0], strength))
    return out
