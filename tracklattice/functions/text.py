"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented letters and their plain forms
ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūýÿñçš ž".replace(" ", "")
PLAIN = "aaaaaaaeeeeeiiiiiooooooouuuuuyyncsz"
# fixed values: mix names and their canonical form
MIX_FORMS = {
    "original mix": "original mix", "original": "original mix", "extended mix": "extended mix", "extended": "extended mix", "extended remix": "extended mix",
    "radio edit": "radio edit", "radio mix": "radio edit", "dub mix": "dub mix", "dub": "dub mix", "vip": "vip", "vip mix": "vip",
    "instrumental": "instrumental", "instrumental mix": "instrumental", "live": "live", "live version": "live",
}


def squeezed(c: Column) -> Column:
    """Lower case, single spaces, no space at either end; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


# fixed values: words that credit a guest, words between equal artists, words that name a mix
GUEST_WORDS = ["featuring", "feat", "feat.", "ft", "ft."]
EQUAL_WORDS = ["and", "vs", "vs."]
MIX_WORDS = ["mix", "edit", "dub", "version", "vip", "instrumental", "live"]


def _words(c: Column) -> Column:
    return F.filter(F.split(squeezed(c), " "), lambda w: w != "")


def normalise_artist(c: Column) -> Column:
    """Credits word by word: every spelling of a guest credit becomes feat, signs and words between equal artists become &."""
    said = _words(F.replace(F.replace(c, F.lit(","), F.lit(" & ")), F.lit("&"), F.lit(" & ")))
    last = F.size(said) - 1
    return F.array_join(F.transform(said, lambda w, i: F.when(w.isin(GUEST_WORDS), "feat").when((i > 0) & (i < last) & w.isin(EQUAL_WORDS), "&").otherwise(w)), " ")


def normalise_title(c: Column) -> Column:
    """Title without guest credits: brackets that open with one, and all from one on that stands by itself after the first word."""
    pieces = F.split(F.translate(squeezed(c), "[]", "()"), r"\(")
    credit = lambda piece: F.element_at(F.split(F.trim(piece), " "), 1).isin(GUEST_WORDS)
    after = lambda piece: F.when(F.contains(piece, F.lit(")")), F.substring_index(piece, ")", -1)).otherwise(F.lit(""))
    kept = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).when(credit(x), after(x)).otherwise(F.concat(F.lit("("), x))), "")
    said = _words(kept)
    guest = F.array_position(F.transform(said, lambda w, i: (i > 0) & w.isin(GUEST_WORDS)), True)
    return F.array_join(F.when(guest > 0, F.slice(said, 1, guest.cast("int") - 1)).otherwise(said), " ")


def normalise_mix(c: Column) -> Column:
    """Mix name without brackets, in its canonical form where it has one."""
    x = F.trim(F.regexp_replace(squeezed(c), r"^[(\[]+|[)\]]+$", ""))
    forms = F.create_map(*[F.lit(v) for kv in MIX_FORMS.items() for v in kv])
    return F.coalesce(forms[x], x)


def split_mix(c: Column) -> tuple[Column, Column]:
    """(title, mix): the mix is what stands in a bracket at the end of the title, if one of its words names a mix or ends in the name of one."""
    whole = F.rtrim(c)
    inner = F.substring_index(F.translate(whole, "[]", "()"), "(", -1)
    closed = whole.rlike(r"[)\]]$") & (F.length(inner) < F.length(whole))
    said = F.trim(F.regexp_replace(inner, r"\)$", ""))
    named = F.exists(F.split(F.lower(said), r"[^a-z0-9]+"), lambda w: F.greatest(*[F.endswith(w, F.lit(m)) for m in MIX_WORDS]))
    found = closed & named
    return F.trim(F.when(found, F.substring(whole, F.lit(1), F.length(whole) - F.length(inner) - 1)).otherwise(c)), F.when(found, said).otherwise(F.lit(""))


def fold_accents(c: Column) -> Column:
    """Lower case without accents, for letters of the fixed list."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def tokens(c: Column, least: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of letters and digits in order of first appearance."""
    words = F.filter(F.split(F.regexp_replace(fold_accents(c), r"[^a-z0-9]+", " "), " "), lambda w: F.length(w) >= least)
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(s) for s in stop])) if stop else words)


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words joined by a space."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def compact_code(c: Column, letters: int = 4) -> Column:
    """First letters of each word in upper case, joined by a dot."""
    words = F.filter(F.split(F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, letters)), ".")


def safe_name(c: Column) -> Column:
    """Characters that file systems refuse, replaced by an underscore."""
    return F.trim(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"))


def sanitised_cell(c: Column) -> Column:
    """A cell that spreadsheets would run as a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def clock_seconds(c: Column) -> Column:
    """Seconds of m:ss or h:mm:ss; null for other text."""
    p = F.split(F.trim(c), ":")
    n = F.transform(p, lambda x: x.cast("int"))
    return F.when(F.trim(c).rlike(r"^\d{1,3}(:\d{2}){1,2}$"), F.aggregate(n, F.lit(0), lambda acc, x: acc * 60 + x))


def file_stem(c: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(c, r"[/\\]"), -1), r"\.[^.]+$", "")


def year_of(c: Column) -> Column:
    """Leading four digits as a year."""
    return F.when(c.rlike(r"^\d{4}"), F.substring(c, 1, 4).cast("int"))
