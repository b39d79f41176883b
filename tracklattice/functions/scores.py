"""Scorecards, bands and labels derived from numeric features, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: thresholds of the energy composite, value bands, confidence levels
ENERGY_STEPS = [0.25, 0.42, 0.58, 0.75]
VALUE_BANDS = [(0.25, "very_low"), (0.45, "low"), (0.65, "mid"), (0.82, "high")]
LEVELS = [(0.85, "high"), (0.70, "medium-high"), (0.55, "medium"), (0.35, "low")]


def clip01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def rising(c: Column, weight: float, offset: float, span: float) -> Column:
    """weight times how far c has come from offset over span, within 0 and 1."""
    return F.lit(weight) * clip01((c - F.lit(offset)) / F.lit(span))


def falling(c: Column, weight: float, offset: float, span: float) -> Column:
    """weight times how far c lies under offset over span, within 0 and 1."""
    return F.lit(weight) * clip01((F.lit(offset) - c) / F.lit(span))


def energy_composite(beat: Column, onset: Column, centroid: Column, loudness: Column) -> Column:
    return rising(beat, 0.35, 1.5, 2.5) + rising(onset, 0.30, 1.0, 2.0) + rising(centroid, 0.20, 1000.0, 2000.0) + rising(loudness, 0.15, 0.15, 0.20)


def energy_level(composite: Column) -> Column:
    """1 to 5: one more than the thresholds reached."""
    return sum((F.when(composite >= t, 1).otherwise(0) for t in ENERGY_STEPS), F.lit(1))


def energy_confidence(composite: Column) -> Column:
    """Distance to the nearest threshold over a tenth, at most 1."""
    return F.least(F.lit(1.0), F.least(*[F.abs(composite - t) for t in ENERGY_STEPS]) / 0.10)


def value_band(c: Column) -> Column:
    out = F.lit("very_high")
    for top, name in reversed(VALUE_BANDS):
        out = F.when(c < top, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def confidence_level(c: Column) -> Column:
    out = F.lit("unknown")
    for low, name in reversed(LEVELS):
        out = F.when(c >= low, F.lit(name)).otherwise(out)
    return out


def best_of(scores: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(label of the highest score, the score, its gap to the second); ties go to the first label in alphabetical order."""
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(n).alias("n")) for n, s in sorted(scores.items())]))
    return ranked[0]["n"], -ranked[0]["s"], (ranked[1]["s"] - ranked[0]["s"])


def mood_scores(f: dict[str, Column]) -> dict[str, Column]:
    """Eight base moods from onset variance, spectral and loudness features (keys as used below)."""
    onset_var = f["onset_variance"] / (f["onset_density"] * f["onset_density"] + 1e-8)
    cv = f["centroid_variance"] / (f["centroid"] * f["centroid"] + 1e-8)
    stability = F.lit(1.0) - F.least(F.lit(1.0), cv * 10)
    # fixed values: weights, centres and spans of the base moods
    moods = {
        "MEL": F.least(F.lit(1.0), f["chroma_variance"] / 0.10) * 0.55 + clip01((F.lit(0.025) - f["flatness"]) / 0.015) * 0.20,
        "DRK": rising(onset_var, 0.25, 2, 2) + rising(f["flatness"], 0.30, 0.018, 0.030) + rising(f["low"], 0.25, 50, 25) + rising(f["flux"], 0.20, 2.5, 2.5),
        "TRIB": rising(f["percussive"], 0.70, 0.40, 0.15) + falling(f["flatness"], 0.44, 0.03, 0.02),
        "RAW": falling(f["low"], 0.45, 42, 12) + falling(f["onset_density"], 0.30, 1.5, 0.8) + falling(onset_var, 0.25, 1.5, 1.0),
        "HYPN": stability * 0.5 + falling(onset_var, 0.50, 2, 1.5),
        "DEEP": falling(f["centroid"], 0.35, 2000, 1000) + falling(f["rms"], 0.35, 0.22, 0.10) + rising(f["low"], 0.30, 50, 20),
        "ACID": rising(cv, 1.0, 0.75, 0.40),
        "ATM": falling(f["onset_density"], 0.50, 1.5, 1.0) + falling(f["rms"], 0.50, 0.20, 0.08),
    }
    return {name: clip01(score) for name, score in moods.items()}


def service_moods(f: dict[str, Column], a: dict[str, Column]) -> dict[str, Column]:
    """The eight base moods with the terms that values of a service add: valence, energy, instrumentalness, liveness, acousticness; null values add nothing."""
    # fixed values: weight, centre and span of each term; a minus before the name means the lower the stronger
    terms = {
        "DRK": [("-valence", 0.15, 0.35, 0.25), ("energy", 0.10, 0.60, 0.30)], "HYPN": [("instrumentalness", 0.15, 0.70, 0.25), ("-valence", 0.10, 0.40, 0.30)],
        "TRIB": [("instrumentalness", 0.10, 0.70, 0.25), ("energy", 0.10, 0.60, 0.30)], "DEEP": [("-energy", 0.15, 0.40, 0.25), ("-valence", 0.10, 0.35, 0.25)],
        "ATM": [("-energy", 0.15, 0.35, 0.25), ("acousticness", 0.10, 0.40, 0.30)], "RAW": [("liveness", 0.15, 0.40, 0.30)], "MEL": [("valence", 0.15, 0.50, 0.30)],
    }
    out = {}
    for name, score in mood_scores(f).items():
        for term, *numbers in terms.get(name, []):
            value = a[term.lstrip("-")]
            score = score + F.coalesce((falling if term[0] == "-" else rising)(value, *numbers), F.lit(0.0))
        out[name] = clip01(score)
    return out


def all_moods(f: dict[str, Column], a: dict[str, Column]) -> dict[str, Column]:
    """Twenty-two moods: the base ones and weighted sums of them with features and service values, or what stands for missing values."""
    b = service_moods(f, a)
    cv = f["centroid_variance"] / (f["centroid"] * f["centroid"] + 1e-8)
    onset_var = f["onset_variance"] / (f["onset_density"] * f["onset_density"] + 1e-8)
    bright = F.coalesce(a["valence"], clip01(f["chroma_variance"] / 0.12))
    gloomy = F.coalesce(1.0 - a["valence"], b["DRK"])
    strong = F.coalesce(a["energy"], F.greatest(b["DRK"], b["TRIB"]))
    calm = F.coalesce(1.0 - a["energy"], F.greatest(b["DEEP"], b["ATM"]))
    acoustic = F.coalesce(a["acousticness"], clip01((F.lit(0.03) - f["flatness"]) / 0.03))
    live = F.coalesce(a["liveness"], clip01(f["percussive"]))
    # fixed values: weights of the sums
    sums = {
        "CIN": [(0.58, b["ATM"]), (0.34, b["MEL"]), (0.08, calm)], "EMO": [(0.58, b["MEL"]), (0.32, gloomy), (0.10, b["DEEP"])], "EUP": [(0.48, b["MEL"]), (0.32, bright), (0.20, strong)],
        "GRIT": [(0.54, b["RAW"]), (0.30, b["DRK"]), (0.16, clip01(f["flux"] / 5.0))], "MIN": [(0.52, b["HYPN"]), (0.28, b["DEEP"]), (0.20, clip01((F.lit(2.0) - f["onset_density"]) / 2.0))],
        "ORG": [(0.50, b["TRIB"]), (0.30, acoustic), (0.20, live)], "PLAY": [(0.42, bright), (0.30, clip01(f["onset_density"] / 3.0)), (0.28, b["MEL"])],
        "PSY": [(0.52, b["ACID"]), (0.30, b["HYPN"]), (0.18, clip01(cv))], "SOUL": [(0.46, bright), (0.30, b["MEL"]), (0.24, acoustic)], "SUB": [(0.64, b["DEEP"]), (0.36, clip01((f["low"] - 45.0) / 35.0))],
        "SUN": [(0.46, bright), (0.30, calm), (0.24, b["MEL"])], "TENS": [(0.46, b["DRK"]), (0.28, gloomy), (0.26, clip01(onset_var / 4.0))], "WARM": [(0.42, bright), (0.34, b["DEEP"]), (0.24, acoustic)],
        "WHSE": [(0.46, b["RAW"]), (0.34, b["DRK"]), (0.20, strong)],
    }
    return b | {name: clip01(sum((w * x for w, x in parts), F.lit(0.0))) for name, parts in sums.items()}


def vocal_scores(presence: Column, sustained: Column, sung: Column, f: dict[str, Column], a: dict[str, Column], moods: dict[str, Column]) -> dict[str, Column]:
    """Seven vocal profiles; those that do not fit the flag are damped (0.65 of INST, TOOL and DUB where sung, 0.45 of the rest where not)."""
    missing = 1.0 - presence
    instrumental, speech, acoustic = (F.coalesce(a[k], F.lit(0.0)) for k in ("instrumentalness", "speechiness", "acousticness"))
    deep = moods["DEEP"] + moods["SUB"] + moods["MIN"] + moods["ATM"]
    echo = clip01(sustained / 0.15) * clip01((F.lit(0.60) - sustained) / 0.40)
    # fixed values: weights of the profiles
    out = {
        "INST": clip01(0.65 * missing + 0.35 * instrumental),
        "TOOL": clip01(0.45 * missing + rising(f["onset_density"], 0.30, 1.8, 1.6) + falling(f["chroma_variance"], 0.15, 0.06, 0.06) + rising(f["percussive"], 0.10, 0.35, 0.40)),
        "DUB": clip01(echo * (0.50 * missing + 0.30 * deep + 0.10 * acoustic + 0.10 * instrumental)),
        "VOC": clip01(0.70 * presence + 0.20 * (1.0 - instrumental) + 0.10 * sustained),
        "FVOC": clip01(0.55 * presence + 0.30 * sustained + 0.15 * (1.0 - instrumental)),
        "SPK": clip01(0.65 * speech + 0.20 * presence + 0.15 * (1.0 - sustained)),
        "CHANT": clip01(0.35 * presence + 0.45 * moods["TRIB"] + 0.20 * sustained),
    }
    return {k: c * F.when(sung, 0.65 if k in ("INST", "TOOL", "DUB") else 1.0).otherwise(1.0 if k in ("INST", "TOOL", "DUB") else 0.45) for k, c in out.items()}


# fixed values: thresholds of the vocal flag
def vocal_presence(ratio: Column, activity: Column) -> Column:
    return clip01(clip01((ratio + 40) / 30) * 0.55 + clip01(activity / 0.7) * 0.45)


def has_vocals(ratio: Column, activity: Column) -> Column:
    return F.when(ratio < -35, False).when((ratio < -30) & (activity < 0.20), False).when((ratio > -25) | (activity > 0.40), True).otherwise(vocal_presence(ratio, activity) > 0.45)


def role(flow: Column, energy: Column, mood: Column) -> Column:
    """Part that a track plays in a set: the first rule that holds (fixed values)."""
    return (
        F.when(flow == "B", "BREAKDOWN")
        .when((energy <= 2) & (flow == "L"), "TOOL")
        .when((energy <= 2) & mood.isin("ATM", "CIN", "DEEP", "SUB", "SUN"), "RESET")
        .when(energy <= 2, "TOOL")
        .when(energy >= 4, "PEAK")
        .when((energy == 3) & mood.isin("MEL", "EMO", "EUP", "SOUL", "WARM", "ATM", "CIN", "DEEP", "SUN"), "BRIDGE")
        .otherwise("DRIVER")
    )


def model_confidence(p: Column, margin: Column, groups: Column) -> Column:
    """Confidence of a flat model from its best probability, the gap to the next, and how many feature groups were there."""
    return F.least(F.lit(0.98), F.greatest(F.lit(0.05), p * 0.64 + margin * 0.18 + 0.18 + F.least(F.lit(0.12), groups / 30)))


def duration_suspect(expected: Column, actual: Column, seconds: float = 20.0, share: float = 0.12) -> Column:
    """Both more than seconds and more than a share apart."""
    gap = F.abs(expected - actual)
    return (expected > 0) & (actual > 0) & (gap > seconds) & (gap > expected * share)
