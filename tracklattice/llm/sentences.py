"""Sentence boundaries across languages and scripts, from statistics of the corpus itself.

A first pass counts, for every language and for all together, what stands before and after periods and after marks that are sure
ends. Log-likelihood ratios of these counts give three lists: words that start sentences, words with a period that do not end one
(abbreviations), and words that follow a number or a one-word exclamation within a sentence (collocations). The second pass walks
over each text with these lists; layout (blank lines, list items), quotations, brackets and scripts without spaces or periods
are read from the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklattice.session import materialise

# fixed values: marks of the writing systems
ENDERS = ".!?…。！？؟।॥"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "‘": "’", "‚": "‘’", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]"}
DOUBLE, ROUND = "“„«「", "(（"
CLOSERS = "”’»›」』》)）]\"'"
CONTINUE = ",;:—–-、，；：،"
_STOP = re.compile("[。！？!?，,]")
ATTRIBUTION = re.compile("[说說问問喊道叫答笑]")
JAPANESE_QUOTE_PARTICLE = "とってはがをのに"
EMOJI = re.compile(r"(?:[\U0001F1E6-\U0001F1FF]{2}|[←-⇿⌀-⏿☀-➿⬀-⯿\U0001F000-\U0001FAFF][︎️‍\U0001F3FB-\U0001F3FF⃣\U000E0020-\U000E007F♀♂☀-➿\U0001F300-\U0001FAFF]*)")
_BREAK = re.compile(r"\r\n|[\n\r  \x85]")
_ITEM = re.compile(r"\s*(?:([-*•‣◦·–—])\s+|(\d{1,3}[.)])\s+|(\d{1,2}:\d\d(?::\d\d)?)\s+)\S")
_FINISHED = re.compile(r"[.!?…。！？؟।:：;；\"”’»›」』》)）\]\U0001F000-\U0001FAFF☀-➿️]\s*$")
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿]")
_MARKS = re.compile(r"[.!?…。！？؟।॥;;]+|[“„«‹‘‚「『《(（\[”’»›」』》)）\]]|[\u0e00-\u0e7f](?=\s)")
#: scripts that end sentences with a space, like any other break; letters of one final particle at most
_UNMARKED = re.compile("[\u0e00-\u0e7f]")
PARTICLE = 5
#: log-likelihood ratio from which on a difference counts (one in a thousand by chance)
RATIO = 10.83
#: the same for words that start sentences, of which some are rare, and for final particles, which stand before most other breaks as well (one in twenty)
STARTER_RATIO = 3.84
#: words of all lists together that the tasks may be sent; more raise an error
MOST_WORDS = 500_000
_OPENERS = "\ufeff\u200b“„«‹‘‚「『《(（[\"'¿¡"
_GAP = re.compile(r"\s(?=\S*$)")
_SURE = re.compile(r"(?:[!?؟।！？。]+|(?<=[Ͱ-Ͽἀ-῿])[;;])[)）]*$")


@dataclass
class Model:
    """Lists by language; "*" holds those of all texts together."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    plain: dict[str, set[str]] = field(default_factory=dict)  # words with a period that do end sentences
    after_number: dict[str, set[str]] = field(default_factory=dict)
    after_shout: dict[str, set[str]] = field(default_factory=dict)
    final: set[str] = field(default_factory=set)  # last letters of sentences in scripts without end marks

    @cached_property
    def longest(self) -> int:
        return max((len(w) for words in self.abbreviations.values() for w in words), default=0) + 16

    def is_abbreviation(self, lang: str, word: str) -> bool:
        if word in self.abbreviations.get(lang, ()):
            return True
        return word not in self.plain.get(lang, ()) and word in self.abbreviations.get("*", ())

    def is_final(self, tail: str) -> bool:
        return any(tail[-n:] in self.final for n in range(2, PARTICLE + 1))

    def follows_number(self, lang: str, word: str) -> bool:
        return word in self.after_number.get(lang, ()) or word in self.after_number.get("*", ())

    def follows_shout(self, lang: str, word: str) -> bool:
        return word in self.after_shout.get(lang, ()) or word in self.after_shout.get("*", ())


def language(label: str | None) -> str:
    """Label in one form: lower case, without region; "" where it says nothing."""
    code = re.split("[-_]", (label or "").strip().lower())[0]
    return code if re.fullmatch("[a-z]{2,3}", code) and code not in ("und", "mul", "unk", "xx") else ""


def runs(text: str) -> list[tuple[int, int, bool]]:
    """(begin, end, is list item): stretches that no sentence crosses; single line breaks inside a run do not count."""
    lines, begin = [], 0
    for m in _BREAK.finditer(text):
        lines.append((begin, m.start()))
        begin = m.end()
    lines.append((begin, len(text)))
    styles = []
    for a, b in lines:
        m = _ITEM.match(text, a, b)
        styles.append(0 if not m else 1 if m[1] else 2 if m[2] else 3)
    out: list[tuple[int, int, bool]] = []
    open_at = -1
    prev_item, prev_blank = False, True
    for k, (a, b) in enumerate(lines):
        if not text[a:b].strip():
            if open_at >= 0:
                out.append((open_at, lines[k - 1][1], False))
            open_at, prev_item, prev_blank = -1, False, True
            continue
        style = styles[k]
        item = False
        if style:
            finished = prev_blank or prev_item or (open_at >= 0 and _FINISHED.search(text[lines[k - 1][0] : lines[k - 1][1]]) is not None)
            company = (prev_item and styles[k - 1] == style) or (k + 1 < len(lines) and styles[k + 1] == style) or style == 1 or (k + 1 == len(lines) or not text[slice(*lines[k + 1])].strip())
            item = finished and company
        if item:
            if open_at >= 0:
                out.append((open_at, lines[k - 1][1], False))
                open_at = -1
            out.append((a, b, True))
        elif open_at < 0:
            open_at = a
        prev_item, prev_blank = item, False
    if open_at >= 0:
        out.append((open_at, lines[-1][1], False))
    return out


_STOPS = frozenset(ENDERS + CLOSERS)
_MAY_END = _STOPS | set(";;")


def count_contexts(text: str, lang: str, into: Counter) -> None:
    """Adds (language, kind, left, next) counts of one text."""
    keys = {lang, "*"} - {""}
    unmarked = _UNMARKED.search(text) is not None
    for a, b, item in runs(text):
        if item:
            continue
        toks = text[a:b].split()
        if unmarked:
            for i, t in enumerate(toks):
                t = t.rstrip(CLOSERS)
                if t and _UNMARKED.match(t[-1]):
                    for n in range(2, PARTICLE + 1):
                        if len(t) >= n:
                            into["*", "final" if i + 1 == len(toks) else "space", t[-n:], ""] += 1
        prev_end, p = True, ""
        for i, t in enumerate(toks):
            if i and p[-1] not in _MAY_END and t[0].islower():  # inside a sentence, and no word that could start one
                prev_end, p = False, t
                continue
            word = t.lstrip(_OPENERS)
            w = word.rstrip(ENDERS + CLOSERS + ",;:")
            kind = ""
            if i == 0:
                kind = "sure" if len(toks) > 4 else ""
            elif p[-1] in _MAY_END and _SURE.search(p):
                kind = "shout" if prev_end and p.endswith("!") and len(p) > 2 else "sure"
            elif p.endswith("."):
                left = p[:-1].lstrip(_OPENERS)
                if left and left[-1] not in _STOPS:
                    left = "##" if left[-1].isdigit() else left
                    nxt = "<o>" if not w[:1].isalnum() else "<l>" if w[:1].islower() else "<d>" if w[:1].isdigit() else w
                    for key in keys:
                        into[key, "period", left, nxt] += 1
            elif p[-1] not in _STOPS:
                kind = "mid"
            if kind and w and w[0].isalpha() and not w[0].islower():
                for key in keys:
                    into[key, kind, "", w] += 1
            prev_end, p = i == 0 or p[-1] in ENDERS or p.rstrip(CLOSERS)[-1:] in ENDERS, t


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 5) -> Model:
    """The lists of a corpus: counts over all texts, summed before they are shuffled, then reduced to the lists by ratio tests.

    Starters, collocations and final particles are those words whose rate differs by a log-likelihood ratio of RATIO; abbreviations are words after whose
    period sentences start less often than after sure ends, by their ratio. All of it stays in tables; what comes to the driver are the lists, of MOST_WORDS
    words at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["lang"]):
                count_contexts(text, language(label), total)
            if len(total) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "kind", "word", "next", "n"])
                total = Counter()
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "kind", "word", "next", "n"])

    shape = "lang string, kind string, word string, next string, n long"
    counts = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null").mapInPandas(run, shape)
    counts = counts.groupBy("lang", "kind", "word", "next").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "contexts")
    words_at = counts.where("kind in ('sure', 'mid', 'shout')").groupBy("lang", "next").pivot("kind", ["sure", "mid", "shout"]).agg(F.sum("n")).na.fill(0)
    all_at = words_at.groupBy("lang").agg(*[F.sum(k).alias(f"all_{k}") for k in ("sure", "mid", "shout")])
    # words that start sentences: more frequent after sure ends than inside sentences
    starters = words_at.join(F.broadcast(all_at), "lang").where((likelihood_ratio("sure", "all_sure", "mid", "all_mid") >= STARTER_RATIO) & (F.col("mid") <= 0.25 * (F.col("sure") + F.col("mid")))).select("lang", "next", F.col("sure").alias("n_sure"))
    starters = materialise(starters, "starters")
    base = starters.groupBy("lang").agg(F.sum("n_sure").alias("by_starters")).join(all_at, "lang").select("lang", (F.col("by_starters") / F.col("all_sure")).alias("base"))
    pairs = counts.where("kind = 'period'")
    left = (
        pairs.where("word <> '##'").join(starters.select("lang", "next", F.lit(1).alias("starts")), ["lang", "next"], "left")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum(F.coalesce("starts", F.lit(0)) * F.col("n")).alias("n_start"))
        .where(F.col("n") >= least).join(F.broadcast(base), "lang")
    )
    # a language decides on a word where it has a fair share of its occurrences, all texts together otherwise
    pooled = left.where("lang = '*'").select("word", F.col("n").alias("n_all"))
    left = left.join(pooled, "word").where((F.col("lang") == "*") | (F.col("n") >= 0.3 * F.col("n_all")))
    # of n periods after this word, as many sentence starts are expected as after sure ends, if it ends sentences
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.coalesce("base", F.lit(0.01))))
    rate = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("n_start") / F.col("n")))
    ratio = 2 * F.col("n") * (rate * F.log(rate / p) + (1 - rate) * F.log((1 - rate) / (1 - p)))
    short = (rate < 0.4 * p) & (ratio > 4 + 6 * F.greatest(F.lit(0), F.length("word") - 3))  # long words need more evidence
    left = left.select("lang", "word", short.alias("short"))
    everywhere = left.where("short and lang = '*'").select("word")
    plain = left.where("not short and lang <> '*'").join(everywhere, "word", "left_semi")  # languages in which an abbreviation of the others is none
    # words that follow numbers, or one-word exclamations, more often than periods that end sentences
    ends = pairs.where("length(word) >= 5 and not contains(word, '.')").groupBy("lang", "next").agg(F.sum("n").alias("n_plain"))
    all_ends = ends.groupBy("lang").agg(F.sum("n_plain").alias("all_plain"))
    numbers = pairs.where("word = '##' and next not in ('<l>', '<d>', '<o>')").groupBy("lang", "next").agg(F.sum("n").alias("n"))
    numbers = numbers.join(starters, ["lang", "next"], "left_anti")
    shouts = counts.where("kind = 'shout'").select("lang", "next", "n")

    def follow(side: DataFrame, whole: DataFrame) -> DataFrame:
        both = side.where(F.col("n") >= least).join(F.broadcast(whole), "lang").join(ends, ["lang", "next"], "left").join(F.broadcast(all_ends), "lang").na.fill(0, ["n_plain"])
        often = F.col("n") / F.col("whole") > 6 * (F.col("n_plain") + 1) / F.greatest(F.lit(1), F.col("all_plain"))
        return both.where(often & (likelihood_ratio("n", "whole", "n_plain", "all_plain") >= RATIO)).select("lang", F.col("next").alias("word"))

    number_words = follow(numbers, pairs.where("word = '##' and next not in ('<l>', '<d>', '<o>')").groupBy("lang").agg(F.sum("n").alias("whole")))
    shout_words = follow(shouts, all_at.select("lang", F.col("all_shout").alias("whole")))
    # letters before the last break of a stretch against letters before any other break
    tails = counts.where("kind in ('final', 'space')").groupBy("word").pivot("kind", ["final", "space"]).agg(F.sum("n")).na.fill(0)
    all_tails = tails.where("length(word) = 2").agg(F.coalesce(F.sum("final"), F.lit(0)).alias("all_final"), F.coalesce(F.sum("space"), F.lit(0)).alias("all_space"))
    tails = tails.crossJoin(F.broadcast(all_tails))  # one row of totals
    final = tails.where((likelihood_ratio("final", "all_final", "space", "all_space") >= STARTER_RATIO) & (F.col("final") * F.col("all_space") > F.col("space") * F.col("all_final"))).select(F.lit("*").alias("lang"), "word", F.col("final").alias("n"))
    lists = None
    for name, found in (("abbreviations", left.where("short").select("lang", "word")), ("plain", plain.select("lang", "word")), ("after_number", number_words), ("after_shout", shout_words), ("final", final)):
        part = found.select(F.lit(name).alias("list"), "lang", "word", F.col("n") if name == "final" else F.lit(0).alias("n"))
        lists = part if lists is None else lists.unionByName(part)
    lists = materialise(lists, "lists")
    if lists.count() > MOST_WORDS:
        raise ValueError("the lists hold more than MOST_WORDS words; raise `least`")
    model = Model()
    tails_at: dict[str, int] = {}
    for r in lists.collect():
        if r["list"] == "final":
            tails_at[r["word"]] = r["n"]
        else:
            getattr(model, r["list"]).setdefault(r["lang"], set()).add(r["word"])
    # letters that nearly always stand at the end of one longer particle are no particle themselves
    model.final = {w for w, n in tails_at.items() if not any(len(x) > len(w) and x.endswith(w) and m >= 0.9 * n for x, m in tails_at.items())}
    return model


def likelihood_ratio(k: str, n: str, l: str, m: str) -> Column:
    """Log-likelihood ratio of k of n against l of m having one rate in common; 0 where the first rate is not the higher one."""
    a, n, b, m = (F.col(x).cast("double") for x in (k, n, l, m))
    n, m = F.greatest(n, F.lit(1.0)), F.greatest(m, F.lit(1.0))
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(F.lit(0.0))
    p = (a + b) / (n + m)
    ratio = 2 * (part(a, n * p) + part(n - a, n * (1 - p)) + part(b, m * p) + part(m - b, m * (1 - p)))
    return F.when(a * m > b * n, ratio).otherwise(F.lit(0.0))


def _spans(text: str, a: int, b: int) -> dict[int, int]:
    """Opening place -> closing place of the outermost quotations and brackets of a run; those never closed are left out."""
    stack: list[int] = []
    inner: list[tuple[int, int]] = []
    for m in re.finditer("[“„«‹‘‚「『《(（\\[”’»›」』》)）\\]]", text[a:b]):
        c, i = m[0], a + m.start()
        if stack and c in PAIRS[text[stack[-1]]]:
            if c == "’" and i + 1 < b and text[i + 1].isalpha() and text[i - 1].isalpha() and not _CJK.match(text[i + 1]):
                continue  # apostrophe
            inner.append((stack.pop(), i))
        elif c in PAIRS:
            if c == "‘" and i > a and text[i - 1].isalpha() and not _CJK.match(text[i - 1]):
                continue
            stack.append(i)
        elif c in ")）]”»」』》›" and any(c in PAIRS[text[o]] for o in stack):
            while c not in PAIRS[text[stack[-1]]]:
                stack.pop()
            inner.append((stack.pop(), i))
    out: dict[int, int] = {}
    last = -1
    for o, c in sorted(inner):
        if o > last:
            out[o] = c
            last = c
    return out


def _after(text: str, i: int, b: int) -> tuple[int, int]:
    """(end with trailing emoji, place of the next sign that is no white space) from i on."""
    end = i
    while True:
        j = end
        while j < b and text[j].isspace():
            j += 1
        m = EMOJI.match(text, j, b)
        if not m:
            return end, j
        end = m.end()


def sentence_ends(text: str, model: Model, lang: str = "") -> list[int]:
    """Code points up to and including the last sign that is not white space, for each sentence."""
    ends: list[int] = []
    for a, b, item in runs(text):
        while b > a and text[b - 1].isspace():
            b -= 1
        if b <= a:
            continue
        if not item:
            ends += _run_ends(text, a, b, model, lang)
        ends.append(b)
    return ends


def _run_ends(text: str, a: int, b: int, model: Model, lang: str) -> list[int]:
    ends: list[int] = []
    spans = _spans(text, a, b)
    start = at = first = seen = a
    while start < b and text[start].isspace():
        start += 1
    while at < b:
        m = _MARKS.search(text, at, b)
        if not m:
            break
        i, mark = m.start(), m[0]
        if mark[0] in PAIRS and i in spans:
            close = spans[i]
            at = close + 1
            kind = text[i]
            inside = text[i + 1 : close].rstrip()
            if not inside or inside[-1] not in ENDERS or kind not in DOUBLE + ROUND:
                continue
            end, nxt = _after(text, close + 1, b)
            if nxt >= b:
                break
            n = text[nxt]
            opens = i == start
            if n in ENDERS and end == close + 1 and nxt == close + 1 and not text.startswith(("…", "..."), nxt):
                continue  # the mark that follows decides
            if n.islower() or n in CONTINUE:
                if not (nxt > end and n in "-–" and opens is False):
                    continue
            if kind in ROUND:
                split = opens
            elif text[close] == "」" or n in JAPANESE_QUOTE_PARTICLE:
                split = n not in JAPANESE_QUOTE_PARTICLE
            elif opens and inside[-1] in "。！？…":
                stop = _STOP.search(text, nxt, b)
                split = not ATTRIBUTION.search(text, nxt, stop.start() if stop else b)
            else:
                split = True
            if split:
                ends.append(end)
                start = at = nxt
            continue
        if mark[0] in PAIRS or mark in "”’»›」』》)）]":
            at = i + 1
            continue
        j = m.end()
        if mark[0] in ";;":
            if not ("Ͱ" <= text[i - 1] <= "Ͽ" or "ἀ" <= text[i - 1] <= "῿") or i == a:
                at = i + 1
                continue
        if _UNMARKED.match(mark):
            if not model.is_final(text[max(start, j - PARTICLE) : j]):
                at = j
                continue
            end, nxt = _after(text, j, b)
            if nxt < b and text[nxt] not in CONTINUE + ENDERS:
                ends.append(end)
                start = at = nxt
            else:
                at = j
            continue
        while j < b and text[j] in CLOSERS:
            j += 1
        end, nxt = _after(text, j, b)
        if nxt >= b:
            break
        if i == start:  # marks that open a sentence
            at = j
            continue
        gap = _GAP.search(text, max(seen, start), i)
        first, seen = gap.end() if gap else max(first, start), i  # where the word before the mark begins
        if _ends_here(text, i, mark, j, end, nxt, start, first, b, model, lang):
            ends.append(end)
            start = at = nxt
        else:
            at = j
    return ends


def _word_at(text: str, i: int, b: int) -> str:
    m = re.compile(r"\S+").match(text, i, b)
    return m[0].lstrip(_OPENERS).rstrip(ENDERS + CLOSERS + ",;:") if m else ""


def _ends_here(text: str, i: int, mark: str, j: int, end: int, nxt: int, start: int, first: int, b: int, model: Model, lang: str) -> bool:
    n = text[nxt]
    emoji = end > j
    spaced = nxt > j
    if n in CONTINUE:
        return False
    if n.islower() and mark[-1] not in "。！？؟।॥":
        return emoji and mark != "…"
    wide = bool(_CJK.match(n)) or n in "「『《（“"
    if mark[-1] in "。！？؟।॥":
        return n not in CLOSERS
    if set(mark) <= {"…"} or (set(mark) == {"."} and len(mark) > 1):
        if _CJK.match(text[i - 1]) or _CJK.match(n):
            return spaced and not _CJK.match(n) and n.isupper()
        return spaced or n.isupper()
    if mark[-1] in "!?;;":
        said = text[start:i].strip() if mark == "!" and spaced else ""
        if said and not re.search(r"\s", said) and said[:1].isupper() and model.follows_shout(lang, _word_at(text, nxt, b)):
            return False
        return spaced or n.isupper() or wide or n in _OPENERS
    # a period, perhaps with other marks
    if len(mark) > 1 and set(mark) & set("!?"):
        return True
    word = text[max(first, i - model.longest) : i].lstrip(_OPENERS)
    short = i - first <= model.longest and model.is_abbreviation(lang, word)  # longer than any abbreviation otherwise
    quoted = j > i + len(mark) or (word and word[-1] in CLOSERS)
    if not spaced:
        if n.isdigit() or not (n.isupper() or wide or n in _OPENERS or not n.isascii()):
            return False
        tail = re.search(r"[^\W\d_]+$", word)
        return bool(word) and (quoted or (tail is not None and len(tail[0]) >= 2 and tail[0][-1].islower() or word[-1].isdigit() or word[-1] in "%°")) and not short
    if quoted or not word:
        return True
    nxt_word = _word_at(text, nxt, b)
    if word[-1].isdigit():
        return not model.follows_number(lang, nxt_word)
    if len(word) == 1 and word.isupper() and n not in _OPENERS:
        return False
    return not short


def split_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id_col, end_char), one for each sentence of each document.

    Null, empty and white texts give no row; a document delivered twice gives its rows twice; a text without any mark is one
    sentence for each paragraph. Labels that are null, wrong or in another form fall back on the lists of all texts. Texts are
    read whole, in one narrow map. The model is a few lists of words (see learn), sent to the tasks.
    """
    shape = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("end_char", T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for begin in range(0, len(pdf), 256):
                ids, ends = [], []
                for key, text, label in pdf.iloc[begin : begin + 256].itertuples(index=False):
                    got = sentence_ends(text, sent.value, language(label))
                    ids += [key] * len(got)
                    ends += got
                yield pd.DataFrame({id_col: ids, "end_char": ends})

    src = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col)).where(F.col(text_col).isNotNull())
    return src.mapInPandas(run, shape)
