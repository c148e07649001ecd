"""Numpy analysers of one signal: the report that ``probe`` gives for each signal of a packed table.

Degenerate signals (empty, short, silent) give null, empty or zero fields, never an error.
"""

from __future__ import annotations

import math

import numpy as np

from siglume.functions.scalars import NOTE_NAMES
from siglume.operators.spectral import CHORDS, MAJOR, MINOR, checkerboard, dct_table

SCHEMA_VERSION = 5


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Magnitudes (frames x bins) under a symmetric Hann window; no frame if the signal is shorter than one."""
    if len(x) < size:
        return np.zeros((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    out = np.empty((len(frames), size // 2 + 1))
    w = np.hanning(size)
    for k in range(0, len(frames), 256):
        out[k : k + 256] = np.abs(np.fft.rfft(frames[k : k + 256] * w, axis=1))
    return out


def half_away(v):
    return np.sign(v) * np.floor(np.abs(v) + 0.5)


def db(v: float) -> float | None:
    return 20 * math.log10(v) if v > 0 else None


def upper_median(v: np.ndarray) -> float:
    return float(np.sort(v)[len(v) // 2])


def threshold(f: np.ndarray, half: int, scale: float, least: float) -> np.ndarray:
    out = np.empty(len(f))
    for t in range(len(f)):
        w = f[max(0, t - half) : t + half + 1]
        m = upper_median(w)
        out[t] = m + scale * upper_median(np.abs(w - m)) + least
    return out


def local_peaks(f: np.ndarray, thr) -> np.ndarray:
    if len(f) < 3:
        return np.zeros(0, dtype=int)
    mid = f[1:-1]
    return np.flatnonzero((mid > np.broadcast_to(thr, f.shape)[1:-1]) & (mid >= f[:-2]) & (mid > f[2:])) + 1


def thin(places: np.ndarray, f: np.ndarray, gap: int) -> list[int]:
    """Chained non-maximum suppression: the gap counts from the strongest so far, which moves."""
    out: list[int] = []
    for p in places:
        if out and p - out[-1] <= gap:
            if f[p] > f[out[-1]]:
                out[-1] = int(p)
        else:
            out.append(int(p))
    return out


def flux_of(mag: np.ndarray) -> np.ndarray:
    if not len(mag):
        return np.zeros(0)
    return np.concatenate([[0.0], np.maximum(np.diff(mag, axis=0), 0).sum(axis=1)])


def onset_frames(flux: np.ndarray, rate: int) -> list[int]:
    gap = max(1, math.ceil(0.030 * rate / 256))
    return thin(local_peaks(flux, threshold(flux, 10, 8.0, 1e-6)), flux, gap)


def frame_ms(t, rate: int):
    return (np.asarray(t) * 256 + 512) / rate * 1000


def biquad(x: np.ndarray, b: tuple, a: tuple, block: int = 256) -> np.ndarray:
    """Second-order filter, a block at a time: the block's own response is a product with the impulse response, and only
    the two numbers of state pass from block to block."""
    n = len(x)
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    push = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    powers = np.empty((block + 1, 2, 2))
    powers[0] = np.eye(2)
    for k in range(block):
        powers[k + 1] = powers[k] @ step
    impulse = np.concatenate([[b[0]], (powers[: block - 1] @ push)[:, 0]])
    own = np.zeros((block, block))
    for k in range(block):
        own[k:, k] = impulse[: block - k]
    held, into = powers[:block, 0, :], (powers[block - 1 :: -1] @ push).T  # output of a state, and state of a block's samples
    parts = np.zeros((-(-n // block), block))
    parts.ravel()[:n] = x
    gained, state, states = parts @ into.T, np.zeros(2), np.empty((len(parts), 2))
    for k, g in enumerate(gained):
        states[k] = state
        state = powers[block] @ state + g
    return (parts @ own.T + states @ held.T).ravel()[:n]


def k_weighting(rate: int) -> list[tuple[tuple, tuple]]:
    """The two filters of ITU-R BS.1770 at any rate."""
    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = math.tan(math.pi * f0 / rate)
    vh = 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = (((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0), (1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0))
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return [shelf, ((1.0, -2.0, 1.0), (1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0))]


def loudness(chans: np.ndarray, rate: int) -> dict:
    """Integrated, momentary and short-term maxima (LUFS), true and sample peak (dBFS), loudness range (LU)."""
    step = rate // 10
    n = chans.shape[1] // step if step else 0
    power = np.zeros(n)
    for c in chans:
        y = c.astype(float)
        for b, a in k_weighting(rate):
            y = biquad(y, b, a)
        power += (y[: n * step].reshape(n, step) ** 2).mean(axis=1) if n else 0
    lufs = lambda p: -0.691 + 10 * np.log10(np.maximum(p, 1e-300))

    def windows(k: int) -> np.ndarray:
        return np.convolve(power, np.ones(k) / k, "valid") if n >= k else np.zeros(0)

    def gated(p: np.ndarray, down: float) -> np.ndarray:
        p = p[lufs(p) > -70]
        return p[lufs(p) > lufs(p.mean()) - down] if len(p) else p

    m, s = windows(4), windows(30)
    live, wide = gated(m, 10), gated(s, 20)
    peak = float(np.abs(chans).max()) if chans.size else 0.0
    top = lambda p: float(lufs(p.max())) if len(p) and p.max() > 1e-20 else None
    return {
        "integrated": float(lufs(live.mean())) if len(live) else None, "momentary_max": top(m), "short_term_max": top(s),
        "true_peak": db(true_peak(chans, rate)), "sample_peak": db(peak),
        "lra": float(np.percentile(lufs(wide), 95) - np.percentile(lufs(wide), 10)) if len(wide) else None,
    }


def true_peak(chans: np.ndarray, rate: int) -> float:
    """Largest absolute value after oversampling (4 times below 96 kHz, 2 below 192) by a 48-tap windowed sinc."""
    up = 4 if rate < 96_000 else 2 if rate < 192_000 else 1
    best = float(np.abs(chans).max()) if chans.size else 0.0
    taps = 48 // up
    for c in chans if up > 1 else ():
        for phase in range(1, up):
            k = np.arange(taps) - taps / 2 + phase / up
            h = np.sinc(k) * np.hanning(taps + 2)[1:-1]
            best = max(best, float(np.abs(np.convolve(c, h / h.sum(), "valid")).max()) if len(c) >= taps else 0.0)
    return best


def yin(frame: np.ndarray, rate: float, limit: float = 0.1) -> float | None:
    """Fundamental of one frame, or None: difference over the shrinking overlap, normalised by its running mean."""
    n = len(frame)
    top = n // 2
    if top < 3:
        return None
    x = frame.astype(float)
    sq = np.concatenate([[0.0], np.cumsum(x * x)])
    spec = np.fft.rfft(x, 2 * n)
    auto = np.fft.irfft(spec * np.conj(spec))[: top + 1]
    lag = np.arange(top + 1)
    diff = np.maximum(sq[n - lag] + (sq[n] - sq[lag]) - 2 * auto, 0)
    diff[0] = 0
    run = np.cumsum(diff)
    c = np.ones(top + 1)
    ok = run > 1e-12
    c[ok] = diff[ok] * lag[ok] / run[ok]
    below = np.flatnonzero(c[2:top] < limit)
    if not len(below):
        return None
    t = int(below[0]) + 2
    while t + 1 < top and c[t + 1] < c[t]:
        t += 1
    a, b, d = c[t - 1], c[t], c[min(t + 1, top)]
    bend = a - 2 * b + d
    shift = 0.5 * (a - d) / bend if abs(bend) > 1e-12 else 0.0
    return rate / (t + (shift if abs(shift) <= 1 else 0.0))


def f0_track(x: np.ndarray, rate: int) -> list[float | None]:
    return [yin(x[k : k + 2048], rate) for k in range(0, len(x) - 2047, 512)]


def midi_of(hz: float) -> int:
    return int(half_away(69 + 12 * math.log2(hz / 440)))


def name_of(midi: int) -> str:
    return f"{NOTE_NAMES[midi % 12]}{midi // 12 - 1}"


def melody(track: list[float | None], rate: int) -> list[dict]:
    """Notes of the quantised track: one-frame repair left to right, runs, none shorter than 75 ms."""
    q = [None if f is None else midi_of(f) for f in track]
    for k in range(1, len(q) - 1):
        if q[k - 1] is not None and q[k - 1] == q[k + 1]:
            q[k] = q[k - 1]
    out, k = [], 0
    while k < len(q):
        j = k
        while j < len(q) and q[j] == q[k]:
            j += 1
        start, end = k * 512 / rate * 1000, j * 512 / rate * 1000
        if q[k] is not None and end - start >= 75:
            true = [f for f in track[k:j] if f is not None and midi_of(f) == q[k]]
            hz = float(np.median(true)) if true else 440 * 2 ** ((q[k] - 69) / 12)
            out.append({"start_ms": start, "end_ms": end, "midi": q[k], "name": name_of(q[k]), "f0_hz": hz, "cents": 1200 * math.log2(hz / (440 * 2 ** ((q[k] - 69) / 12)))})
        k = j
    return out


def pitch(track: list[float | None]) -> dict:
    voiced = [f for f in track if f is not None]
    return {"voiced_ratio": len(voiced) / len(track) if track else 0.0, "median_f0_hz": float(np.median(voiced)) if voiced else None}


def timbre(x: np.ndarray, rate: int) -> dict | None:
    if len(x) < 2048:
        return None
    power = stft(x, 2048, 512) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(min(16000.0, rate / 2)), 28) / 2595) - 1)
    hz = np.arange(1025) * rate / 2048
    rise, fall = (hz - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - hz) / np.diff(edges)[1:, None]
    bands = power @ np.maximum(np.minimum(rise, fall), 0).T
    floor = np.maximum(bands.max(axis=1, keepdims=True) * 1e-8, 1e-10)
    dct = np.zeros((13, 26))
    for c, b, w in dct_table(26, 13):
        dct[c, b] = w
    ceps = np.log(np.maximum(bands, floor)) @ dct.T
    return {"mfcc_mean": ceps.mean(axis=0).tolist(), "mfcc_std": ceps.std(axis=0).tolist(), "frames": len(ceps)}


def chroma_frames(mag: np.ndarray, rate: int, size: int) -> np.ndarray:
    hz = np.arange(mag.shape[1]) * rate / size
    use = (hz >= 55) & (hz <= 5000)
    pc = (half_away(69 + 12 * np.log2(hz[use] / 440)) % 12).astype(int)
    out = np.zeros((len(mag), 12))
    for k in range(12):
        out[:, k] = mag[:, use][:, pc == k].sum(axis=1)
    return out


def key_of(c: np.ndarray) -> tuple[int, int, float]:
    best = (0, 0, 0.0)
    if c.std() > 0:
        top = -2.0
        for t in range(12):
            for m, p in ((0, MAJOR), (1, MINOR)):
                r = float(np.corrcoef(c, np.roll(p, t))[0, 1])
                if r > top + 1e-12:
                    best, top = (t, m, r), r
    return best


def silence(x: np.ndarray, rate: int, floor: float = -60.0) -> dict:
    win, hop, n = max(1, int(half_away(0.05 * rate))), max(1, int(half_away(0.01 * rate))), len(x)
    spans = []
    for a in range(0, n, hop):
        w = x[a : a + win]
        level = db(float(np.sqrt((w * w).mean())))
        if level is not None and level > floor:
            spans.append((a, min(a + win, n)))
        if a + win >= n:
            break
    ms = 1000 / rate
    if not spans:
        return {"leading_ms": n * ms, "trailing_ms": n * ms, "last_audible_sample": None, "floor_dbfs": floor}
    return {"leading_ms": spans[0][0] * ms, "trailing_ms": (n - spans[-1][1]) * ms, "last_audible_sample": spans[-1][1] - 1, "floor_dbfs": floor}


def stereo(chans: np.ndarray) -> dict | None:
    if len(chans) != 2 or not chans.shape[1]:
        return None
    l, r = chans.astype(float)
    rms = lambda v: float(np.sqrt((v * v).mean()))
    mid, side, a, b = rms((l + r) / 2), rms((l - r) / 2), rms(l), rms(r)
    flat = l.var() <= 0 or r.var() <= 0
    return {
        "width": side / (mid + side) if mid + side > 0 else 0.0, "correlation": None if flat else float(np.clip(np.corrcoef(l, r)[0, 1], -1, 1)),
        "balance": (b - a) / (a + b) if a + b > 0 else None,
    }


def prior(bpm: float) -> float:
    return math.exp(-0.5 * (math.log2(bpm / 120) / 1.3) ** 2)


def tempo_peaks(flux: np.ndarray, low: int, high: int, rate: float) -> list[tuple[int, float]]:
    n, d = len(flux), flux - flux.mean()
    ac0 = float(d @ d)
    if ac0 <= np.finfo(float).eps:
        return []
    lags = np.arange(low, high + 1)
    c = np.clip([float(d[: n - k] @ d[k:]) * n / (ac0 * (n - k)) for k in lags], 0, 1)
    w = c * [prior(rate * 60 / k) for k in lags]
    best = int(np.argmax(w))
    if w[best] <= 0:
        return []
    top = [i for i in range(len(w)) if w[i] > 0 and (i == 0 or w[i] >= w[i - 1]) and (i + 1 == len(w) or w[i] > w[i + 1])]
    got = [best]
    for i in sorted(top, key=lambda i: (-w[i], i)):
        if len(got) < 3 and all(abs(lags[i] - lags[j]) / lags[j] > 0.10 for j in got):
            got.append(i)
    return [(int(lags[i]), float(c[i])) for i in got]


def beats(flux: np.ndarray, period: int, penalty: float = 400.0) -> list[int]:
    sd = flux.std() if len(flux) else 0.0
    if sd * sd <= np.finfo(float).eps or period < 1:
        return []
    x, n = flux / sd, len(flux)
    score, back, half = np.zeros(n), np.full(n, -1), max(1, int(period / 2 + 0.5))
    cost = penalty * np.log(np.arange(1, 2 * period + 1) / period) ** 2  # by interval, from 1
    for t in range(n):
        lo, hi, gain = max(0, t - 2 * period), t - half, 0.0
        if hi >= lo:
            cand = score[lo : hi + 1] - cost[t - np.arange(lo, hi + 1) - 1]
            k = int(np.argmax(cand))
            if cand[k] > 0:
                gain, back[t] = cand[k], lo + k
        score[t] = x[t] + gain
    at, out = int(np.argmax(score)), []
    while at >= 0:
        out.append(at)
        at = int(back[at])
    return out[::-1]


def tempo(flux: np.ndarray, onsets: list[int], rate: int, low_bpm: float = 30.0, high_bpm: float = 300.0) -> dict:
    low_bpm, high_bpm = min(low_bpm, high_bpm), max(low_bpm, high_bpm)
    fr = rate / 256
    low, high = max(1, int(half_away(fr * 60 / high_bpm))), int(half_away(fr * 60 / low_bpm))
    empty = {"bpm": None, "confidence": 0.0, "candidates": [], "stability": None, "beats_ms": [], "downbeat": None}
    n = len(flux)
    if n < 3 or len(onsets) < 2 or n <= high + 1 or not (got := tempo_peaks(flux, low, high, fr)):
        return empty
    lag = got[0][0]
    chunks, stable = min(4, n // (high + 2)), None
    if chunks >= 2:
        size = n // chunks
        lags = [p[0][0] for k in range(chunks) if (p := tempo_peaks(flux[k * size : (k + 1) * size], low, high, fr))]
        stable = sum(any(abs(v * f - lag) <= 0.05 * lag for f in (0.25, 0.5, 1, 2, 4)) for v in lags) / chunks
    grid = beats(flux, lag)
    strength = [sum(flux[b] for b in grid[k::4]) for k in range(min(4, len(grid)))]
    return {
        "bpm": fr * 60 / lag, "confidence": got[0][1], "candidates": [{"bpm": fr * 60 / k, "salience": c} for k, c in got], "stability": stable,
        "beats_ms": frame_ms(grid, rate).tolist(), "downbeat": int(np.argmax(strength)) if strength else None,
    }


def grid_hits(onsets: list[float], grid: list[float], parts: int) -> tuple[int, int]:
    on = off = 0
    g = np.array([2 * grid[0] - grid[1], *grid, 2 * grid[-1] - grid[-2]])
    for t in onsets:
        k = int(np.searchsorted(g, t, "right")) - 1
        if t == g[-1]:
            k = len(g) - 2
        if not 0 <= k < len(g) - 1 or g[k + 1] <= g[k]:
            continue
        sub = (g[k + 1] - g[k]) / parts
        pos = (t - g[k]) / sub
        near = float(half_away(pos))
        if abs(pos - near) * sub <= max(0.15 * sub, 10.0):
            on += 1
            off += int(near) % parts != 0
    return on, off


def rhythm(onsets_ms: list[float], t: dict, seconds: float) -> dict:
    rate = len(onsets_ms) / seconds if seconds > 0 else 0.0
    if len(t["beats_ms"]) < 2 or not onsets_ms:
        return {"grid_alignment": None, "grid": None, "offbeat_ratio": None, "onset_rate_per_s": rate, "clear_rhythm": False}
    four, three = grid_hits(onsets_ms, t["beats_ms"], 4), grid_hits(onsets_ms, t["beats_ms"], 3)
    kind, (on, off) = ("triplet", three) if three[0] > four[0] else ("straight", four)
    align = on / len(onsets_ms)
    clear = t["confidence"] >= 0.1 and rate >= 0.5 and align >= 0.7
    return {"grid_alignment": align, "grid": kind, "offbeat_ratio": off / on if on else None, "onset_rate_per_s": rate, "clear_rhythm": clear}


def structure(x: np.ndarray, rate: int) -> dict:
    n = len(x) / rate
    frames = math.ceil(n)
    one = {"boundaries_ms": [], "section_count": 1 if len(x) else 0, "confidence": 0.0}
    if frames < 16:
        return one
    size_ms = 1000.0 * max(1, math.ceil(frames / 50_000))
    count = math.ceil(n * 1000 / size_ms)
    mag = stft(x, 4096, 1024)
    if not len(mag):
        return one
    at = np.minimum(((np.arange(len(mag)) * 1024 + 2048) / rate * 1000 // size_ms).astype(int), count - 1)
    hz = np.arange(mag.shape[1]) * rate / 4096
    ch = chroma_frames(mag, rate, 4096)
    en = mag**2
    bands = np.stack([en[:, hz < 250].sum(1), en[:, (hz >= 250) & (hz <= 4000)].sum(1), en[:, hz > 4000].sum(1)], axis=1)
    v = np.zeros((count, 16))
    np.add.at(v[:, :12], at, ch)
    np.add.at(v[:, 12:15], at, bands)
    v[:, :12] /= np.maximum(v[:, :12].max(axis=1, keepdims=True), 1e-300)
    v[:, 12:15] /= np.maximum(v[:, 12:15].sum(axis=1, keepdims=True), 1e-300)
    edges = np.minimum((np.arange(count + 1) * size_ms / 1000 * rate).astype(int), len(x))
    v[:, 15] = [float(np.sqrt((x[a:b] ** 2).mean())) if b > a else 0.0 for a, b in zip(edges, edges[1:])]
    norm = np.linalg.norm(v, axis=1)
    u = np.where(norm[:, None] > 0, v / np.maximum(norm[:, None], 1e-300), 0)
    nov = np.zeros(count)
    for a, b, w in checkerboard(8, 4.0):
        t = np.arange(8, count - 7)
        nov[t] += w * np.clip((u[t + a] * u[np.minimum(t + b, count - 1)]).sum(axis=1), 0, 1)
    nov[np.abs(nov) < 1e-6] = 0.0  # rounding noise of a steady signal
    med = upper_median(nov)
    picked = thin(local_peaks(nov, med + 1.5 * upper_median(np.abs(nov - med))), nov, math.ceil(4000 / size_ms))
    picked = sorted(sorted(picked, key=lambda p: (-nov[p], p))[:11])
    span = nov.max() - med
    sure = float(np.clip(np.mean([max(nov[p] - med, 0) for p in picked]) / span, 0, 1)) if picked and span > 0 else 0.0
    return {"boundaries_ms": [p * size_ms for p in picked], "section_count": len(picked) + 1, "confidence": sure}


def chords(chroma: np.ndarray, rate: int, total_ms: float) -> list[dict]:
    """Chord spans of 250 ms buckets; runs under 500 ms take the label of the nearest labelled run before, else after."""
    if not len(chroma):
        return []
    count = math.ceil(total_ms / 250)
    at = np.minimum(((np.arange(len(chroma)) * 2048 + 4096) / rate * 1000 // 250).astype(int), count - 1)
    c = np.zeros((count, 12))
    np.add.at(c, at, chroma)
    labels: list = []
    for row in c:
        good, top = [], row.max()
        for qi, (q, tones) in enumerate(CHORDS):
            for root in range(12):
                idx = [(root + k) % 12 for k in tones]
                if top > 0 and (row[idx] >= 0.4 * top).all():
                    cos = row[idx].sum() / (np.linalg.norm(row) * math.sqrt(len(tones)))
                    if cos >= 0.6:
                        good.append((cos, len(tones), qi, root, q))
        best = max((g[0] for g in good), default=0)
        pick = min(((g[1], -g[0], g[2], g[3], g[4]) for g in good if g[0] >= best - 0.06), default=None)
        labels.append(None if pick is None else (pick[3], pick[4], -pick[1]))
    runs = []
    for k, l in enumerate(labels):
        key = None if l is None else l[:2]
        if runs and runs[-1][0] == key:
            runs[-1][2] = k + 1
        else:
            runs.append([key, k, k + 1])
    fixed = []
    for k, (key, a, b) in enumerate(runs):
        if key is not None and b - a < 2:
            before = next((r[0] for r in reversed(runs[:k]) if r[0] is not None), None)
            key = before or next((r[0] for r in runs[k + 1 :] if r[0] is not None), key)
        fixed.append([key, a, b])
    out = []
    for key, a, b in fixed:
        if out and out[-1][0] == key:
            out[-1][2] = b
        else:
            out.append([key, a, b])
    return [{"root": NOTE_NAMES[k[0]], "quality": k[1], "start_ms": a * 250.0, "end_ms": min(b * 250.0, total_ms)} for k, a, b in out if k is not None]


def probe(samples: np.ndarray, rate: int, channels: int, start_ms: float = 0.0) -> dict:
    """The whole report of one signal (interleaved samples)."""
    chans = np.asarray(samples, dtype=np.float32).reshape(-1, channels).T.astype(float)
    x = chans.mean(axis=0) if chans.size else np.zeros(0)
    total = len(x) / rate * 1000
    small = stft(x, 1024, 256)
    flux = flux_of(small)
    on = onset_frames(flux, rate)
    on_ms = frame_ms(on, rate).tolist()
    track = f0_track(x, rate)
    t = tempo(flux, on, rate)
    large = stft(x, 8192, 2048)
    ch = chroma_frames(large, rate, 8192)
    whole = ch.sum(axis=0)
    tonic, mode, sure = key_of(whole)
    loud = loudness(chans, rate)
    sections = structure(x, rate)
    spans = chords(ch, rate, total)
    beat = np.diff(t["beats_ms"])
    clip = int((np.abs(chans) >= 1.0).sum())
    return {
        "schema_version": SCHEMA_VERSION,
        "source": {"sample_rate": rate, "channels": channels, "samples": len(x), "duration_ms": total, "start_ms": start_ms},
        "loudness": loud, "onsets": {"count": len(on_ms), "times_ms": on_ms},
        "pitch": pitch(track) | {"melody": melody(track, rate)}, "timbre": timbre(x, rate),
        "key": {"tonic": NOTE_NAMES[tonic], "mode": ("major", "minor")[mode], "confidence": sure, "chroma": (whole / whole.max()).tolist() if whole.max() > 0 else [0.0] * 12},
        "silence": silence(x, rate), "clipping": {"clipped_samples": clip, "true_peak_over_0dbtp": loud["true_peak"] is not None and loud["true_peak"] > 0},
        "tempo": {k: t[k] for k in ("bpm", "confidence", "candidates", "stability")} | {"beat_count": len(t["beats_ms"]), "mean_beat_interval_ms": float(beat.mean()) if len(beat) else None},
        "rhythm": rhythm(on_ms, t, total / 1000), "stereo": stereo(chans), "structure": sections,
        "harmony": {"chords": spans, "chord_coverage": sum(s["end_ms"] - s["start_ms"] for s in spans) / total if total > 0 else 0.0},
    }


def timeline(x: np.ndarray, rate: int, window_ms: float = 1000.0, floor: float = -60.0) -> list[dict]:
    """Consecutive windows of one mono signal: levels, onsets, pitch and band shares; the last may be partial."""
    if not (math.isfinite(window_ms) and window_ms >= 1):
        raise ValueError("window_ms must be finite and at least 1")
    n, win = len(x), max(1, int(half_away(window_ms / 1000 * rate)))
    count = -(-n // win)
    if not count:
        return []
    mag = stft(x, 1024, 256)
    bucket = lambda at: np.minimum(np.asarray(at) // win, count - 1).astype(int)
    on = np.zeros(count, dtype=int)
    np.add.at(on, bucket([t * 256 + 512 for t in onset_frames(flux_of(mag), rate)]) if len(mag) else [], 1)
    hz, energy, bands = np.arange(513) * rate / 1024, mag**2, np.zeros((count, 3))
    for k, use in enumerate((hz < 250, (hz >= 250) & (hz <= 4000), hz > 4000)):
        if len(mag):
            np.add.at(bands[:, k], bucket(np.arange(len(mag)) * 256 + 512), energy[:, use].sum(axis=1))
    voiced: dict[int, list[float]] = {}
    for k, f in enumerate(f0_track(x, rate)):
        first, last = k * 512 // win, (k * 512 + 2047) // win
        if f is not None and first == last:  # only hops that lie inside one window
            voiced.setdefault(first, []).append(f)
    out = []
    for k in range(count):
        w = x[k * win : (k + 1) * win]
        rms, f0 = db(float(np.sqrt((w * w).mean()))), float(np.median(voiced[k])) if k in voiced else None
        total = bands[k].sum()
        low, mid, high = (bands[k] / total if total > 0 else np.zeros(3)).tolist()
        out.append({
            "index": k, "start_ms": k * win / rate * 1000, "end_ms": min((k + 1) * win, n) / rate * 1000, "rms_db": rms, "peak_db": db(float(np.abs(w).max())),
            "silent": rms is None or rms <= floor, "onsets": int(on[k]), "f0_hz": f0, "midi": None if f0 is None else min(max(midi_of(f0), 0), 127), "low": low, "mid": mid, "high": high,
        })
    return out
