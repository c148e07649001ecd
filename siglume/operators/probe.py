"""Reports, timelines and digests of packed PCM tables: one task a signal, any number of signals."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from siglume.operators import kernels
from siglume.operators.assertions import compare


def _whole(f):
    import numpy as np

    f = f.sort_values("chunk_id")
    return np.concatenate([np.asarray(s, dtype=np.float32) for s in f["samples"]]), int(f["sample_rate"].iloc[0]), int(f["channels"].iloc[0])


def cut(packed: DataFrame, start_s: float, end_s: float | None = None) -> DataFrame:
    """Frames from ``round(start * rate)`` to ``round(end * rate)``, with ``start_ms`` for reports. Chunks outside are pruned by
    their start frame before any samples are touched. An end before the start, or a negative or infinite bound, is an error."""
    if not (0 <= start_s < float("inf")) or end_s is not None and not (start_s < end_s < float("inf")):
        raise ValueError(f"{start_s}..{end_s} s is no window")
    a = F.round(F.lit(start_s) * F.col("sample_rate")).cast("long")
    size = (F.size("samples") / F.col("channels")).cast("long")
    b = F.col("start_frame") + size if end_s is None else F.round(F.lit(end_s) * F.col("sample_rate")).cast("long")
    lo, hi = F.greatest(a, F.col("start_frame")), F.least(b, F.col("start_frame") + size)
    skip = ((lo - F.col("start_frame")) * F.col("channels")).cast("int")
    out = packed.where(hi > lo).withColumn("samples", F.slice("samples", skip + 1, ((hi - lo) * F.col("channels")).cast("int")))
    return out.withColumns({"start_frame": lo - a, "start_ms": F.round(F.lit(start_s) * F.col("sample_rate")) / F.col("sample_rate") * 1000})


def probe(packed: DataFrame) -> DataFrame:
    """``signal_id, report`` (JSON, schema version inside)."""

    def kernel(f):
        import pandas as pd

        x, rate, channels = _whole(f)
        return pd.DataFrame({"signal_id": [f["signal_id"].iloc[0]], "report": [json.dumps(kernels.probe(x, rate, channels, float(f["start_ms"].iloc[0]) if "start_ms" in f else 0.0))]})

    return packed.groupBy("signal_id").applyInPandas(kernel, "signal_id string, report string")


def digest(report: dict) -> str:
    """A report as a few lines of text; undefined loudness reads ``-inf``, other undefined values ``-``."""
    num = lambda v, p: "-" if v is None else f"{v:.{p}f}"
    s, l, t, k = (report[c] for c in ("source", "loudness", "tempo", "key"))
    lines = [
        f"source rate={s['sample_rate']} ch={s['channels']} dur={s['duration_ms'] / 1000:.3f}s",
        f"loudness I={'-inf' if l['integrated'] is None else num(l['integrated'], 1)} M={num(l['momentary_max'], 1)} S={num(l['short_term_max'], 1)} tp={num(l['true_peak'], 1)} lra={num(l['lra'], 1)}",
        f"onsets n={report['onsets']['count']}", f"key {k['tonic']} {k['mode']} conf={k['confidence']:.2f}",
        f"silence lead={report['silence']['leading_ms']:.0f}ms tail={report['silence']['trailing_ms']:.0f}ms clipped={report['clipping']['clipped_samples']}",
    ]
    if t["bpm"] is not None:
        lines.append(f"tempo {t['bpm']:.2f} clarity={t['confidence']:.2f} stability={num(t['stability'], 2)} beats={t['beat_count']}")
    notes = report["pitch"]["melody"]
    if notes:
        lines.append("melody " + " ".join(n["name"] for n in notes[:16]) + (f" +{len(notes) - 16}" if len(notes) > 16 else ""))
    spans = report["harmony"]["chords"]
    if spans:
        lines.append("chords " + " ".join(c["root"] + ("" if c["quality"] == "maj" else c["quality"]) for c in spans[:16]) + (f" +{len(spans) - 16}" if len(spans) > 16 else ""))
    lines.append(f"structure sections={report['structure']['section_count']}")
    return "\n".join(lines) + "\n"


def timeline_text(rows: list[dict], most: int = 40, least: int = 3) -> str:
    """Windows of one signal as lines: merged into equal buckets so that ``most`` lines do, then ``least`` and more silent lines as one."""
    num = lambda v, p: "-" if v is None else f"{v:.{p}f}"
    width, lines = max(1, -(-len(rows) // most)), []
    merged = [rows[k : k + width] for k in range(0, len(rows), width)]
    silent = [all(r["silent"] for r in part) for part in merged]
    k = 0
    while k < len(merged):
        run = k
        while run < len(merged) and silent[run]:
            run += 1
        last = run if run - k >= least else k + 1
        part = [r for p in merged[k:last] for r in p]
        name = f"{part[0]['index']}" + (f"-{part[-1]['index']}" if len(part) > 1 else "")
        if run - k >= least:
            lines.append(f"{name} silent ({(part[-1]['end_ms'] - part[0]['start_ms']) / 1000:.1f} s)")
        else:
            top = lambda c: max((r[c] for r in part if r[c] is not None), default=None)
            f0 = sorted(r["f0_hz"] for r in part if r["f0_hz"] is not None)
            mid = (f0[(len(f0) - 1) // 2] + f0[len(f0) // 2]) / 2 if f0 else None
            lines.append(f"{name} rms={num(top('rms_db'), 1)} peak={num(top('peak_db'), 1)} onsets={sum(r['onsets'] for r in part)} f0={num(mid, 1)}" + (" silent" if silent[k] else ""))
        k = last
    return f"timeline rows={len(lines)}\n" + "".join(x + "\n" for x in lines)


def transcribe(packed: DataFrame, ppq: int = 480, bpm: float = 120.0, grid: int = 120) -> DataFrame:
    """``signal_id, start_tick, ticks, midi, vel``: melody notes on a grid, the first of equal starts, cut at the next start."""

    def kernel(f):
        import numpy as np
        import pandas as pd

        x, rate, channels = _whole(f)
        mono = x.reshape(-1, channels).mean(axis=1).astype(float)
        per_ms = bpm * ppq / 60_000
        rows: list[list] = []
        for n in kernels.melody(kernels.f0_track(mono, rate), rate):
            a, b = (int(n[k] / 1000 * rate) for k in ("start_ms", "end_ms"))
            peak = kernels.db(float(np.abs(mono[a:b]).max()) if b > a else 0.0)
            vel = 1 if peak is None else int(kernels.half_away(1 + min(max((peak + 48) / 48, 0), 1) * 126))
            start = int(n["start_ms"] * per_ms / grid + 0.5) * grid
            ticks = max(grid, int((n["end_ms"] - n["start_ms"]) * per_ms / grid + 0.5) * grid)
            rows.append([start, ticks, n["midi"], vel])
        rows.sort(key=lambda r: (r[0], r[2]))
        kept: list[list] = []
        for r in rows:
            if kept and kept[-1][0] == r[0]:
                continue
            if kept and kept[-1][0] + kept[-1][1] > r[0]:
                kept[-1][1] = r[0] - kept[-1][0]
            kept.append(r)
        out = pd.DataFrame(kept, columns=["start_tick", "ticks", "midi", "vel"])
        out.insert(0, "signal_id", f["signal_id"].iloc[0])
        return out

    return packed.groupBy("signal_id").applyInPandas(kernel, "signal_id string, start_tick long, ticks long, midi long, vel long")


TIMELINE = (
    "signal_id string, index long, start_ms double, end_ms double, rms_db double, peak_db double, silent boolean, onsets long, f0_hz double, midi long, low double, mid double, high double"
)


def timeline(packed: DataFrame, window_ms: float = 1000.0, floor: float = -60.0) -> DataFrame:
    """One row for each window of each signal."""

    def kernel(f):
        import pandas as pd

        x, rate, channels = _whole(f)
        out = pd.DataFrame(kernels.timeline(x.reshape(-1, channels).mean(axis=1).astype(float), rate, window_ms, floor))
        if not len(out):
            return pd.DataFrame(columns=[c.split()[0] for c in TIMELINE.split(", ")])
        out.insert(0, "signal_id", f["signal_id"].iloc[0])
        return out

    return packed.groupBy("signal_id").applyInPandas(kernel, TIMELINE)


def beats(packed: DataFrame) -> DataFrame:
    """``signal_id, beat, t_ms, bar_beat``: the beat grid with its place in the bar of four (0 is the downbeat)."""

    def kernel(f):
        import numpy as np
        import pandas as pd

        x, rate, channels = _whole(f)
        flux = kernels.flux_of(kernels.stft(x.reshape(-1, channels).mean(axis=1).astype(float), 1024, 256))
        t = kernels.tempo(flux, kernels.onset_frames(flux, rate), rate)
        k = np.arange(len(t["beats_ms"]))
        return pd.DataFrame({"signal_id": f["signal_id"].iloc[0], "beat": k, "t_ms": t["beats_ms"], "bar_beat": (k - (t["downbeat"] or 0)) % 4})

    return packed.groupBy("signal_id").applyInPandas(kernel, "signal_id string, beat long, t_ms double, bar_beat long")


def compare_pairs(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, status, result`` for pairs of signal ids: the comparison as JSON, or ``missing_reference`` without ``b``."""
    ra, rb = reports.select(F.col("signal_id").alias("a"), F.col("report").alias("ra")), reports.select(F.col("signal_id").alias("b"), F.col("report").alias("rb"))
    both = pairs.join(ra, "a").join(rb, "b", "left")

    def kernel(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for a, b, x, y in zip(f["a"], f["b"], f["ra"], f["rb"]):
                if not isinstance(y, str):
                    rows.append((a, b, "missing_reference", None))
                    continue
                got = compare(json.loads(x), json.loads(y), x == y)
                rows.append((a, b, got["verdict"]["kind"], json.dumps(got)))
            yield pd.DataFrame(rows, columns=["a", "b", "status", "result"])

    return both.select("a", "b", "ra", "rb").mapInPandas(kernel, "a string, b string, status string, result string")
