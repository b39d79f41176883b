"""Codes of moods and vocal profiles, the comment line that carries them, and reading it back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: mood and vocal codes by name, and further spellings
MOODS = {
    "acidic": "ACID", "atmospheric": "ATM", "cinematic": "CIN", "dark": "DRK", "deep": "DEEP", "emotional": "EMO", "euphoric": "EUP", "gritty": "GRIT", "hypnotic": "HYPN", "melodic": "MEL", "minimal": "MIN",
    "organic": "ORG", "playful": "PLAY", "psychedelic": "PSY", "raw": "RAW", "soulful": "SOUL", "subby": "SUB", "sunlit": "SUN", "tense": "TENS", "tribal": "TRIB", "warehouse": "WHSE", "warm": "WARM",
}
MOOD_ALIASES = {"AMBIENT": "ATM", "ATMOSPHERE": "ATM", "FUNKY": "PLAY", "NOCTURNAL": "DRK", "PERC": "TRIB", "PERCUSSIVE": "TRIB", "SUNSET": "SUN"}
VOCALS = {"chant": "CHANT", "dub": "DUB", "featured_vocal": "FVOC", "instrumental": "INST", "spoken": "SPK", "tool": "TOOL", "vocal": "VOC"}
VOCAL_ALIASES = {
    "CHNT": "CHANT", "DUBBY": "DUB", "FEATURED": "FVOC", "FEATURING": "FVOC", "FV": "FVOC", "HOOK": "FVOC", "INSTR": "INST", "LOW_VOCAL": "VOC", "NO_VOCAL": "INST", "NO_VOCALS": "INST", "NONVOCAL": "INST",
    "SPEECH": "SPK", "SPOKEN_WORD": "SPK", "NV": "INST", "V": "VOC", "VOICE": "VOC",
}
SUNG = ["CHANT", "FVOC", "SPK", "VOC"]
UNSUNG = ["INST", "TOOL", "DUB"]


def _read(value: Column, names: dict[str, str], aliases: dict[str, str]) -> Column:
    """The code that a token stands for; tokens that stand for none pass in upper case, "" stays."""
    token = F.upper(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[\s-]+", "_"))
    known = {**{n.upper(): c for n, c in names.items()}, **aliases}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])[token], token)


def mood_code(value: Column) -> Column:
    return _read(value, MOODS, MOOD_ALIASES)


def vocal_code(value: Column) -> Column:
    return _read(value, VOCALS, VOCAL_ALIASES)


def is_sung(value: Column) -> Column:
    """A profile with words: one of SUNG, or a code of its own that is none of UNSUNG."""
    code = vocal_code(value)
    return (code != "") & ~code.isin(UNSUNG)


def tag_line(key: Column, energy: Column, mood: Column, vocal: Column, category: Column, group: Column) -> Column:
    """KEY|E#|MOOD|VOCAL[|CATEGORY][|GROUP]; what is unknown shows as ?? (E? for the energy)."""
    m, v = mood_code(mood), vocal_code(vocal)
    c = F.upper(F.trim(category))
    return F.concat_ws(
        "|", F.coalesce(key, F.lit("??")), F.concat(F.lit("E"), F.coalesce(energy.cast("string"), F.lit("?"))), F.when(m.isin(*sorted(MOODS.values())), m).otherwise(F.lit("??")),
        F.when(v.isin(*sorted(VOCALS.values())), v).otherwise(F.lit("??")), F.when(c.rlike(r"^[A-Z0-9]{3,4}(\.[A-Z0-9]{3,4})*$") & ~c.rlike(r"^G\d{3}$"), c), F.when(group != "", group),
    )


def tag_fields(line: Column) -> Column:
    """The fields of a comment line as a struct (key, energy, mood, vocal, category, grp); null for other text."""
    pattern = (
        r"^(\d{1,2}[AB]|\?\?)\|E([1-5?])\|(" + "|".join(sorted(MOODS.values(), key=len, reverse=True)) + r"|\?\?)\|(" + "|".join(sorted(VOCALS.values(), key=len, reverse=True))
        + r"|\?\?)(?:\|((?!G\d{3}$)[A-Za-z0-9]{3,4}(?:\.[A-Za-z0-9]{3,4})*))?(?:\|(G\d{3}))?$"
    )
    text = F.trim(line)
    part = lambda n: F.regexp_extract(text, pattern, n)
    blank = lambda c: F.when(c != "", c)
    return F.when(
        text.rlike(pattern), F.struct(part(1).alias("key"), part(2).alias("energy"), part(3).alias("mood"), part(4).alias("vocal"), blank(part(5)).alias("category"), blank(part(6)).alias("grp"))
    )
