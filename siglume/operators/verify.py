"""Assertions over feature tables: one row per check, and whether all checks of a signal passed.

Checks of a value fail on an undefined one, upper bounds pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from siglume.functions.scalars import lin_to_db

#: kind -> (measure, pass rule over the measure, target and tolerance)
RULES = {
    "level_within": ("db", lambda v, a, t: F.coalesce(F.abs(v - a) <= t, F.lit(False))),
    "peak_below": ("pk", lambda v, a, t: F.coalesce(v <= a, F.lit(True))),
    "peak_at_least": ("pk", lambda v, a, t: F.coalesce(v >= a, F.lit(False))),
    "length_at_least": ("n", lambda v, a, t: v >= a),
}


def run_checks(sig: DataFrame, key: str, specs: list[tuple[str, float, float]]) -> DataFrame:
    """``key, kind, passed, actual, all_passed``. The features are computed once for all checks; an unknown kind fails."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    feats = sig.groupBy(key).agg(lin_to_db(rms).alias("db"), F.max(F.abs("x")).alias("pk"), F.count("*").cast("double").alias("n"))
    rows = []
    for kind, target, tol in specs:
        measure, rule = RULES.get(kind, ("n", lambda v, a, t: F.lit(False)))
        v = F.col(measure)
        rows.append(F.struct(F.lit(kind).alias("kind"), rule(v, F.lit(target), F.lit(tol)).alias("passed"), F.round(v, 4).alias("actual")))
    out = feats.select(key, F.inline(F.array(*rows)))
    return out.withColumn("all_passed", F.bool_and("passed").over(W.partitionBy(key)))


#: Checks of one value of a signal's feature table: measure, rule over (value, a, b), and what an undefined value gives.
VALUE_RULES = {
    "integrated_lufs": ("lufs", lambda v, a, b: F.abs(v - a) <= b, False),
    "true_peak_below": ("true_peak", lambda v, a, b: v <= a, True),
    "lra_below": ("lra", lambda v, a, b: v <= a, True),
    "tempo_is": ("bpm", lambda v, a, b: F.abs(v - a) <= b, False),
    "has_clear_rhythm": ("clear", lambda v, a, b: v == a, False),
    "grid_alignment_at_least": ("alignment", lambda v, a, b: v >= a, False),
    "stereo_width_within": ("width", lambda v, a, b: v.between(a, b), False),
    "section_count": ("sections", lambda v, a, b: v.between(a, b), False),
}
#: Checks against a track's own tables; each gives ``spec_id, passed, actual``.
TRACK_KINDS = ("onset_at", "pitch_matches_score", "no_discontinuity", "silent_after", "brightness_rises", "brightness_falls")


def check_values(specs: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """``spec_id, kind, passed, actual, detail`` of specs ``(spec_id, key, kind, a, b)`` against one feature row a signal. A
    signal without features is an unknown track and fails, and so does an unknown kind."""
    both = specs.join(features.withColumn("_there", F.lit(True)), key, "left")
    passed, actual = F.lit(False), F.lit(None).cast("double")
    for kind, (measure, rule, undefined) in VALUE_RULES.items():
        here, v = F.col("kind") == kind, F.col(measure).cast("double")
        passed = F.when(here, F.coalesce(rule(v, F.col("a"), F.col("b")), F.lit(undefined))).otherwise(passed)
        actual = F.when(here, v).otherwise(actual)
    known = F.col("kind").isin(*VALUE_RULES, *TRACK_KINDS)
    detail = F.when(~known, "unknown kind").when(F.col("_there").isNull(), "unknown track").when(actual.isNull(), "undefined")
    return both.select("spec_id", key, "kind", (F.col("_there").isNotNull() & passed).alias("passed"), actual.alias("actual"), detail.alias("detail"))


def check_onsets(specs: DataFrame, onsets: DataFrame, key: str) -> DataFrame:
    """Nearest onset ``t`` to ``a`` within ``b``: ``spec_id, passed, actual`` (the distance); no onset fails."""
    near = specs.where("kind = 'onset_at'").join(onsets.select(key, "t"), key, "left")
    best = near.groupBy("spec_id", "b").agg(F.min(F.abs(F.col("t") - F.col("a"))).alias("actual"))
    return best.select("spec_id", F.coalesce(F.col("actual") <= F.col("b"), F.lit(False)).alias("passed"), "actual")


def check_pitch(specs: DataFrame, notes: DataFrame, track: DataFrame, key: str, hop_ms: float, guard_ms: float = 15.0, least_ms: float = 60.0) -> DataFrame:
    """Every note ``(key, note, on_ms, off_ms, midi)`` of 60 ms or more within ``a`` cents by the median of the voiced hops
    ``(key, i, f0)`` between its guarded start and its end; a note without pitch fails, and so does a track without notes.
    Notes meet hops on the hop's index."""
    from siglume.functions.scalars import cents_off

    mine = specs.where("kind = 'pitch_matches_score'")
    long = notes.where(F.col("off_ms") - F.col("on_ms") >= least_ms)
    first, last = F.ceil((F.col("on_ms") + guard_ms) / hop_ms), F.ceil(F.col("off_ms") / hop_ms) - 1
    at = long.where(last >= first).select(key, "note", "midi", F.explode(F.sequence(first, last)).alias("i"))
    f0 = at.join(track.where("f0 is not null").select(key, "i", "f0"), [key, "i"], "left").groupBy(key, "note", "midi").agg(F.median("f0").alias("f0"))
    cents = f0.select(key, F.abs(cents_off(F.col("f0"), F.col("midi"))).alias("c")).groupBy(key).agg(F.max("c").alias("worst"), F.count_if(F.col("c").isNull()).alias("without"))
    both = mine.join(cents, key, "left")
    return both.select("spec_id", (F.coalesce(F.col("worst") <= F.col("a"), F.lit(False)) & (F.col("without") == 0)).alias("passed"), F.col("worst").alias("actual")).fillna({"passed": False})


def guarded_jumps(sig: DataFrame, edges: DataFrame, key: str, guard: int, floor: float) -> DataFrame:
    """``key, i, jump`` of sample pairs that don't both lie under ``floor`` and don't end within ``guard`` samples of a note
    edge ``(key, at)``. Edges become guarded sample numbers, so pairs leave by an anti join on equal keys."""
    p = F.lag("x").over(W.partitionBy(key).orderBy("i"))
    d = sig.withColumn("p", p).where(F.col("p").isNotNull() & ((F.abs("x") >= floor) | (F.abs("p") >= floor)))
    shut = edges.select(key, F.explode(F.sequence(F.col("at") - guard, F.col("at") + guard)).alias("i")).distinct()
    return d.join(shut, [key, "i"], "left_anti").select(key, "i", F.abs(F.col("x") - F.col("p")).alias("jump"))


def check_jumps(specs: DataFrame, jumps: DataFrame, key: str) -> DataFrame:
    """No guarded jump above ``a``: ``spec_id, passed, actual`` (the worst; a track without pairs passes)."""
    worst = jumps.groupBy(key).agg(F.max("jump").alias("actual"))
    both = specs.where("kind = 'no_discontinuity'").join(worst, key, "left")
    return both.select("spec_id", F.coalesce(F.col("actual") <= F.col("a"), F.lit(True)).alias("passed"), "actual")


def check_tail(specs: DataFrame, hops: DataFrame, key: str) -> DataFrame:
    """The loudest hop ``(key, start, rms)`` from ``a`` on is strictly below ``b`` dB; none there passes."""
    both = specs.where("kind = 'silent_after'").join(hops.select(key, "start", "rms"), key, "left")
    worst = both.groupBy("spec_id", "b").agg(lin_to_db(F.max(F.when(F.col("start") >= F.col("a"), F.col("rms")))).alias("actual"))
    return worst.select("spec_id", F.coalesce(F.col("actual") < F.col("b"), F.lit(True)).alias("passed"), "actual")


def check_brightness(specs: DataFrame, curve: DataFrame, key: str) -> DataFrame:
    """Median centroid ``(key, t, hz)`` of the range's last quarter against the first: at least ``ratio`` times it (rises), or
    the other way (falls). ``a`` to ``b`` is the range; an empty range or an undefined end fails."""
    mine = specs.where("kind in ('brightness_rises', 'brightness_falls')")
    quarter = (F.col("b") - F.col("a")) / 4
    both = mine.join(curve.select(key, "t", "hz"), key, "left").groupBy("spec_id", "kind", "a", "b", "ratio").agg(
        F.median(F.when((F.col("t") >= F.col("a")) & (F.col("t") < F.col("a") + quarter), F.col("hz"))).alias("first"),
        F.median(F.when((F.col("t") >= F.col("b") - quarter) & (F.col("t") < F.col("b")), F.col("hz"))).alias("last"),
    )
    rises = F.col("last") >= F.col("first") * F.col("ratio")
    falls = F.col("first") >= F.col("last") * F.col("ratio")
    ok = F.when(F.col("kind") == "brightness_rises", rises).otherwise(falls) & (F.col("b") > F.col("a"))
    return both.select("spec_id", F.coalesce(ok, F.lit(False)).alias("passed"), F.try_divide("last", "first").alias("actual"))


#: Checks of the text form: kind, and where its two numbers and its ratio stand (a field, or a fixed number).
SPEC_KINDS = {
    "IntegratedLufs": ("integrated_lufs", "target", "tol"), "TruePeakBelow": ("true_peak_below", "dbtp", 0.0), "LraBelow": ("lra_below", "lu", 0.0), "TempoIs": ("tempo_is", "bpm", "tol_bpm"),
    "HasClearRhythm": ("has_clear_rhythm", "expected", 0.0), "GridAlignmentAtLeast": ("grid_alignment_at_least", "min", 0.0), "StereoWidthWithin": ("stereo_width_within", "min", "max"),
    "SectionCount": ("section_count", "min", "max"), "OnsetAt": ("onset_at", "at", "tol_ms"), "PitchMatchesScore": ("pitch_matches_score", "tol_cents", 0.0), "NoDiscontinuity": ("no_discontinuity", "db", 0.0),
    "SilentAfter": ("silent_after", "at", -60.0), "BrightnessRises": ("brightness_rises", "from", "to"), "BrightnessFalls": ("brightness_falls", "from", "to"), "Monotone": ("monotone", "from", "to"),
}


def spec_rows(score, signal: str) -> list[tuple[int, str, str, float, float, float]]:
    """``(spec_id, key, kind, a, b, ratio)`` of a score's checks, for the operators above: positions become milliseconds by its
    tempo map, a level of jumps a linear one; a check of a track is keyed ``signal/track``, of the mix ``signal``."""

    def ms(place) -> float:
        tick, total = score.position(*place), 0.0
        steps = score.tempos
        for k, (start, npq) in enumerate(steps):
            end = steps[k + 1][0] if k + 1 < len(steps) else tick
            total += max(0, min(tick, end) - start) * npq / score.ppq / 1e6
        return total

    out = []
    for n, (kind, fields) in enumerate(score.specs):
        f = dict(fields)
        name, *where = SPEC_KINDS[kind]
        a, b = (w if isinstance(w, float) else ms(f[w]) if w in ("at", "from", "to") else float(f[w]) for w in where)
        a = 10 ** (-a / 20) if name == "no_discontinuity" else a
        out.append((n, f"{signal}/{f['track']}" if "track" in f else signal, name, a, b, float(f.get("min_ratio", 0.0))))
    return out
