"""Feature blocks as long tables (id, feature, value): a map of an entity is one groupBy away, and blocks add up by union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.functions import codes, scores

# fixed values: cues of the energy levels, thresholds of the audio cues, weights of the sources of a genre, bands of popularity
ENERGY_CUES = {1: ["warmup", "deep", "downtempo"], 2: ["warmup", "deep", "downtempo"], 4: ["driver", "rolling"], 5: ["peak", "hard"]}
AUDIO_CUES = [("acousticness", ">=", 0.60, ["acoustic", "rock"]), ("instrumentalness", ">=", 0.75, ["instrumental"]), ("valence", "<=", 0.30, ["dark"]), ("energy", ">=", 0.78, ["driving", "peak"])]
SOURCE_WEIGHTS = {"rekordbox": 1.5, "embedded": 1.2, "songstats": 1.3, "spotify": 1.1}
POPULARITY_BANDS = [(0.25, "lo"), (0.60, "mid"), (9.0, "hi")]
TEMPO_BANDS = [(95, "60_95"), (115, "95_115"), (124, "115_124"), (130, "124_130"), (146, "130_146"), (160, "146_160"), (181, "160_180"), (float("inf"), "180_plus")]


def _entries(*parts: Column) -> Column:
    """One array of (feature, value) of several; features that are null are left out."""
    return F.filter(F.flatten(F.array(*parts)), lambda x: x["feature"].isNotNull() & x["value"].isNotNull())


def one(feature: Column, value: Column | float = 1.0) -> Column:
    return F.array(F.struct(feature.alias("feature"), (F.lit(value) if isinstance(value, float) else value.cast("double")).alias("value")))


def _banded(c: Column, bands: list[tuple[float, str]]) -> Column:
    return F.coalesce(*[F.when(c < top, F.lit(name)) for top, name in bands])


def cues(condition: Column, names: list[str]) -> Column:
    return F.array(*[F.struct(F.when(condition, F.lit(f"cue:{n}")).alias("feature"), F.lit(1.0).alias("value")) for n in names])


def _long(rows: DataFrame, id_col: str, *parts: Column) -> DataFrame:
    each = rows.select(id_col, F.explode(_entries(*parts)).alias("x")).select(id_col, "x.feature", "x.value")
    return each.groupBy(id_col, "feature").agg(F.max("value").alias("value"))


def tagger_block(rows: DataFrame, id_col: str, energy: str, mood: str, vocal: str, bpm: str) -> DataFrame:
    """Rows (id, feature, value) of a tagger's energy (1 to 5), mood, vocal profile and tempo; what is null, blank or not above 0 gives none."""
    e, b = F.col(energy), F.when(F.col(bpm) > 0, F.col(bpm))
    m, v = codes.mood_code(F.col(mood)), codes.vocal_code(F.col(vocal))
    named = lambda prefix, c: one(F.when(c != "", F.concat(F.lit(prefix), c)))
    return _long(
        rows, id_col, named("tagger:energy=", e.cast("string")), one(F.when(e.isNotNull(), F.lit("num:tagger_energy")), e), *[cues(e == k, names) for k, names in ENERGY_CUES.items()], named("tagger:vibe=", m),
        named("tagger:vocal=", v), one(F.when(b.isNotNull(), F.lit("num:bpm")), b), one(F.concat(F.lit("bpm_band:"), _banded(b, TEMPO_BANDS))),
    )


def audio_block(rows: DataFrame, id_col: str, source: str, values: list[str], popularity: str | None = None) -> DataFrame:
    """Rows (id, feature, value) of a service's values between 0 and 1, their bands and cues, and of a popularity up to 100."""
    s = F.col(source)
    parts = []
    for name in values:
        c = F.col(name)
        parts += [one(F.concat(F.lit("num:"), s, F.lit(f":{name}")), c), one(F.concat(F.lit(f"audio_band:{name}:"), scores.value_band(c)))]
    for name, sign, limit, names in AUDIO_CUES:
        if name in values:
            parts.append(cues(F.col(name) >= limit if sign == ">=" else F.col(name) <= limit, names))
    if popularity:
        p = scores.clip01(F.when(F.col(popularity) >= 0, F.col(popularity) / 100.0))
        band = _banded(p, POPULARITY_BANDS)
        known = F.col(popularity) >= 0
        parts += [one(F.when(known, F.concat(F.lit("num:"), s, F.lit(":popularity"))), p), one(F.when(known, F.concat(F.lit("popularity_band:"), s, F.lit(":"), band)))]
    return _long(rows, id_col, *parts)


def provider_block(rows: DataFrame, id_col: str, source: str, genres: str) -> DataFrame:
    """Rows (id, feature, value): provider_genre:<token> with the highest weight of the sources that name it; lists are cut at ; , / and |."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])[F.lower(F.trim(F.col(source)))], F.lit(1.0))
    token = F.regexp_replace(F.trim(F.col("w")), r"\s+", "_")
    each = rows.where(F.col(genres).isNotNull()).select(id_col, weight.alias("value"), F.explode(F.split(F.lower(F.col(genres)), "[;,/|]+")).alias("w")).where(F.trim("w") != "")
    return each.groupBy(id_col, F.concat(F.lit("provider_genre:"), token).alias("feature")).agg(F.max("value").alias("value"))


def prior_block(rows: DataFrame, id_col: str, key: str, priors: DataFrame, kind: str) -> DataFrame:
    """Rows (id, feature, value): the categories that the table priors (key, category, weight) gives an entity's artist or label, by weight; blank keys and
    weights of 0 and less give none."""
    own = rows.select(id_col, F.trim(F.col(key)).alias("key")).where("key <> ''")
    return own.join(priors.where("weight > 0").select("key", "category", "weight"), "key").groupBy(id_col, F.concat(F.lit(f"prior:{kind}:"), F.col("category")).alias("feature")).agg(F.max("weight").alias("value"))


def range_priors(rows: DataFrame, id_col: str, value: str, rules: DataFrame, rule_id: str, low: str, high: str, step: float = 1.0) -> DataFrame:
    """Rows (id, rule_id): the rules whose closed range [low, high] holds the value.

    A rule stands in every step of width `step` that its range touches, so the join is on equal steps and no rows are held against all rules.
    """
    at = lambda c: F.floor(c / F.lit(step))
    cells = rules.where(F.col(low) <= F.col(high)).select(rule_id, F.col(low).alias("__low"), F.col(high).alias("__high"), F.explode(F.sequence(at(F.col(low)), at(F.col(high)))).alias("__at"))
    own = rows.where(F.col(value).isNotNull()).select(id_col, F.col(value).alias("__value"), at(F.col(value)).alias("__at"))
    return own.join(cells, "__at").where(F.col("__value").between(F.col("__low"), F.col("__high"))).select(id_col, rule_id)


def explained(evidence: DataFrame, id_col: str, text: str, weight: str, most: int = 8) -> DataFrame:
    """Rows (id, reasons): the distinct reasons of each entity, the heaviest first, at most `most` (the reader's limit); equal weights in alphabetical order."""
    each = evidence.groupBy(id_col, text).agg(F.max(weight).alias("w"))
    packed = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), F.col(text).alias("t")))).alias("x"))
    return packed.select(id_col, F.slice(F.transform("x", lambda r: r["t"]), 1, most).alias("reasons"))
