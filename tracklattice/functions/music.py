"""Readings of key and tempo notations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the wheel positions 1 to 12 of the minor (A) and major (B) keys, sharps as pitch names
MINOR = ["G#", "D#", "A#", "F", "C", "G", "D", "A", "E", "B", "F#", "C#"]
MAJOR = ["B", "F#", "C#", "G#", "D#", "A#", "F", "C", "G", "D", "A", "E"]
FLATS = {"DB": "C#", "EB": "D#", "GB": "F#", "AB": "G#", "BB": "A#", "CB": "B", "FB": "E", "E#": "F", "B#": "C"}


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def camelot(key: Column) -> Column:
    """Wheel code such as 9A from a wheel code or a key name in any usual notation; null for what is neither.

    Wheel codes take a leading zero and any case; names take sharps and flats as signs or letters and minor as m, min or minor
    (major is the rest). Where both stand together, "8A - Am", the wheel code counts. Codes above 12 or of 0 are no keys.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(key, "[♭]", "b"), "[♯＃]", "#"), r"[\s _]+", " "))
    code = F.regexp_extract(F.upper(text), r"^0?([1-9][0-9]?)([AB])(?![A-Z0-9#])", 1)
    side = F.regexp_extract(F.upper(text), r"^0?([1-9][0-9]?)([AB])(?![A-Z0-9#])", 2)
    number = F.when(code != "", code.cast("int"))
    by_code = F.when(number.between(1, 12), F.concat(number.cast("string"), side))
    pattern = r"^([A-Ga-g])\s?(#|b|sharp|flat|(?i: sharp| flat))?[\s-]?((?i:m|min|minor|maj|major|M|moll|dur)?)$"
    note = F.upper(F.regexp_extract(text, pattern, 1))
    sign = F.lower(F.trim(F.regexp_extract(text, pattern, 2)))
    mode = F.regexp_extract(text, pattern, 3)
    name = F.concat(note, F.when(sign.isin("#", "sharp"), "#").when(sign.isin("b", "flat"), "B").otherwise(""))
    plain = F.coalesce(_lookup(FLATS)[name], name)
    minor = (mode == "m") | F.lower(mode).isin("min", "minor", "moll")
    by_name = F.when(
        note != "",
        F.when(minor, _lookup({n: f"{i}A" for i, n in enumerate(MINOR, 1)})[plain]).otherwise(_lookup({n: f"{i}B" for i, n in enumerate(MAJOR, 1)})[plain]),
    )
    return F.when(code != "", by_code).otherwise(by_name)


def tempo(bpm: Column, low: float = 40.0, high: float = 250.0) -> Column:
    """Beats per minute as DOUBLE from text with a decimal point or comma and an optional unit; null outside [low, high]."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.lower(bpm), r"\s*(bpm|beats per minute)\.?\s*$", "")), ",", ".")
    number = F.expr("try_cast(null as double)") if bpm is None else F.when(text.rlike(r"^\+?[0-9]+(\.[0-9]+)?$"), text.cast("double"))
    return F.when(number.between(low, high), number)


def is_wheel_code(key: Column) -> Column:
    """A wheel code as it should be stored: 1 to 12 and A or B."""
    return F.coalesce(key.rlike("^(1[0-2]|[1-9])[AB]$"), F.lit(False))


def wheel_number(code: Column) -> Column:
    return F.regexp_extract(code, r"^(\d+)", 1).cast("int")


def wheel_position(code: Column) -> Column:
    """0 to 23 in playing order, null for no key."""
    return F.when(is_wheel_code(code), (wheel_number(code) - 1) * 2 + F.when(code.endswith("B"), 1).otherwise(0))


def wheel_distance(a: Column, b: Column) -> Column:
    """Steps round the wheel plus one for another mode; null where a key is unknown."""
    gap = F.abs(wheel_number(a) - wheel_number(b))
    return F.when(is_wheel_code(a) & is_wheel_code(b), F.least(gap, 12 - gap) + F.when(F.right(a, F.lit(1)) != F.right(b, F.lit(1)), 1).otherwise(0))


#: lower ends of the tempo buckets, each up to the next
TEMPO_BUCKETS = [0, 90, 105, 115, 122, 128, 135, 146, 160, 180]


def tempo_bucket(bpm: Column) -> Column:
    """Label of the half-open tempo bucket."""
    labels = [f"{low:03d}-{high:03d}" for low, high in zip(TEMPO_BUCKETS, TEMPO_BUCKETS[1:])] + [f"{TEMPO_BUCKETS[-1]:03d}+"]
    reached = F.size(F.filter(F.array(*[F.lit(float(low)) for low in TEMPO_BUCKETS]), lambda low: low <= bpm))
    return F.when(bpm >= TEMPO_BUCKETS[0], F.get(F.array(*[F.lit(x) for x in labels]), reached - 1))


def key_bucket(code: Column) -> Column:
    """Two neighbouring wheel numbers of one mode, starting at an odd one."""
    n = wheel_number(code)
    low = n - F.when(n % 2 == 0, 1).otherwise(0)
    return F.when(is_wheel_code(code), F.format_string("%02d-%02d%s", low, low + 1, F.right(code, F.lit(1))))
