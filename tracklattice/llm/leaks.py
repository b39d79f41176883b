"""Evaluation texts that stand in training texts, found over template windows.

Both sides are folded and cut into words. Every word that is no word of the evaluation texts' common wording becomes a typed placeholder: a number, a unit
beside a number, or a name. What is left frames a template, and the words behind the placeholders are its slots. Windows of the corpus meet windows of
the evaluation texts in hash joins: over the template together with the value of one slot, for passages; over the template alone, for questions that
are asked again with other values. A pair of windows counts for a passage where all slots but one agree. Texts with agreeing windows are then
aligned word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.llm.filters import Bits, filter_of
from tracklattice.llm.text import fold
from tracklattice.session import materialise

#: share of the evaluation texts of a script that use a word of the common wording; at most (words of a text) / FRAME_SHARE words are sent to the tasks
FRAME_SHARE = 0.05
#: share of an item's characters that must be found again: half, less what spaces and marks, which are not counted here, may make
SHARE = 0.45
WINDOW = 5
WIDE_WINDOW = 10
#: words that may stand between two parts of a passage: one foreign sentence
FOREIGN = 60
SMALL_GAP = 6
NUMBER, UNIT, NAME = 1, 2, 3
# fixed values: units of measure and counting words of the four languages
UNITS = frozenset(
    "bpm hz khz db ms s sec secs second seconds min mins minute minutes h hour hours kb mb gb kbps % ° bars bar beats beat units unit copies copy points point times "
    "takt takte takten punkt punkte punkten einheiten mal sekunden minuten stunden kopien compases compas puntos veces segundos minutos horas copias unidades "
    "枚 点 回 秒 分 時 拍 小節 本 曲".split()
)
_NUMBER_MARK = re.compile(r"(?<=\d)[.,:'’](?=\d)")
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿฀-๿]|[^\W_぀-ヿ㐀-鿿豈-﫿฀-๿]+")


def tokens_of(text: str) -> list[str]:
    """Folded words; scripts without spaces one sign at a time; marks inside numbers dropped."""
    return _TOKEN.findall(_NUMBER_MARK.sub("", fold(text)))


def is_wide(token: str) -> bool:
    return len(token) == 1 and token > "฀"


def mostly_wide(tokens: list[str]) -> bool:
    return sum(map(is_wide, tokens)) * 2 > len(tokens)


def script_of(tokens: list[str]) -> int:
    """Texts are counted apart by the script of most of their signs."""
    places, counts = np.unique([ord(w[0]) >> 8 for w in tokens], return_counts=True)
    return int(places[counts.argmax()])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Templates:
    """Types of words and the keys of windows under one common wording."""

    def __init__(self, frame: frozenset[str]):
        self.frame = frame
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.code: list[int] = []
        self.value: list[int] = []
        self.unit: list[bool] = []

    def _known(self, w: str) -> int:
        at = self.place[w] = len(self.code)
        h = xxhash.xxh64_intdigest(w)
        self.code.append(NUMBER if w[0].isdigit() else h | 16 if w in self.frame else NAME)
        self.value.append(h)
        self.unit.append(w in UNITS)
        return at

    def typed(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(type or word, value) of each token."""
        if len(self.code) > 500_000:
            self._clear()
        place, known = self.place, self._known
        at = np.array([place[w] if w in place else known(w) for w in tokens], dtype=np.int64)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        code = np.array(self.code, dtype=np.uint64)[at]
        number = np.r_[False, code == NUMBER, False]
        code[np.array(self.unit)[at] & (number[:-2] | number[2:])] = UNIT
        return code, np.array(self.value, dtype=np.uint64)[at]

    @staticmethod
    def windows(code: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, template) of all windows that lie within one text; ends: the end of the text of each token."""
        if len(code) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        n = len(code) - size + 1
        h = np.full(n, size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : n + k]
                h ^= h >> np.uint64(29)
        at = np.flatnonzero(ends[:n] - np.arange(n) >= size)
        return at, h[at]

    def keys(self, code: np.ndarray, value: np.ndarray, at: np.ndarray, template: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indexes of windows, keys): first those of the templates alone, then those of each slot with its value.

        A template alone counts where at least two words of the common wording frame a slot.
        """
        slots = (code <= NAME).astype(np.int64)
        total = np.r_[0, np.cumsum(slots)]
        held = total[at + size] - total[at]
        with np.errstate(over="ignore"):
            plain = np.flatnonzero((held > 0) & (held <= size - 2))
            yield plain, _mixed(template[plain] + np.uint64(0x5851F42D4C957F2D))
            for k in range(size):
                w = np.flatnonzero(slots[at + k])
                yield w, _mixed(template[w] + _mixed(value[at[w] + k]) * np.uint64(2 * k + 3))


def _item_tokens(items: DataFrame, item_col: str, item_text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [tokens_of(t) for t in pdf["text"]]
            out = pd.DataFrame({"item_id": pdf["item_id"], "tokens": tokens, "script": [script_of(t) if t else -1 for t in tokens], "wide": [mostly_wide(t) for t in tokens]})
            yield out[out["script"] >= 0]

    src = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    return src.mapInPandas(run, "item_id long, tokens array<string>, script int, wide boolean").dropDuplicates(["item_id"])


def common_wording(items: DataFrame, share: float = FRAME_SHARE) -> frozenset[str]:
    """Words that at least `share` of the item texts of a script use, and more than one; counted once over all items."""
    sizes = items.groupBy("script").agg(F.count("*").alias("n_items"))
    used = items.select("script", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("script", "word").agg(F.count("*").alias("n"))
    common = used.join(sizes, "script").where((F.col("n") >= 2) & (F.col("n") >= share * F.col("n_items")) & ~F.col("word").rlike("^[0-9]"))
    return frozenset(r["word"] for r in common.select("word").distinct().collect())  # bounded by the share, see FRAME_SHARE


def _item_keys(items: DataFrame, frame) -> DataFrame:
    """Rows (key, item_id, at, slots, template): slots is 0 for keys of a template alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(frame.value)
        for pdf in batches:
            for item, tokens, wide in zip(pdf["item_id"], pdf["tokens"], pdf["wide"]):
                tokens = list(tokens)
                size = WIDE_WINDOW if wide else WINDOW
                code, value = templates.typed(tokens)
                at, template = templates.windows(code, np.full(len(code), len(code)), size)
                held = np.array([(code[i : i + size] <= NAME).sum() for i in at], dtype=np.int64)
                for n, (w, keys) in enumerate(templates.keys(code, value, at, template, size)):
                    yield pd.DataFrame({"key": keys.view(np.int64), "item_id": item, "at": at[w], "slots": held[w] * (n > 0), "template": template[w].view(np.int64)})

    return items.select("item_id", "tokens", "wide").mapInPandas(run, "key long, item_id long, at int, slots int, template long")


def _rarest(plain: DataFrame) -> DataFrame:
    """Of each item's templates those of which a text with half of them must hold one: all but half of them, the rarest among the items."""
    each = plain.select("item_id", "key").distinct()
    ranked = each.join(each.groupBy("key").agg(F.count("*").alias("n_items")), "key")
    lists = ranked.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("n_items", "key"))).alias("keys")).where(F.size("keys") >= 4)
    need = F.greatest(F.lit(4), F.ceil(F.size("keys") / 2).cast("int"))
    return lists.select("item_id", F.explode(F.slice("keys", F.lit(1), F.size("keys") - need + 1)).alias("x")).select(F.col("x.key").alias("key"), "item_id")


def _hits(src: DataFrame, frame, bits) -> DataFrame:
    """Rows (doc_id, text, at, keys) of the texts with at least two windows whose key may be one of an item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(frame.value)
        for pdf in batches:
            for begin in range(0, len(pdf), 512):
                part = pdf.iloc[begin : begin + 512]
                yield _hits_of(part, [tokens_of(t) for t in part["text"]], templates, bits.value)

    return src.mapInPandas(run, "doc_id long, text string, at array<int>, keys array<long>")


def _hits_of(part: pd.DataFrame, tokens: list[list[str]], templates: Templates, bits: Bits) -> pd.DataFrame:
    owners, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in (WINDOW, WIDE_WINDOW):
        texts = [i for i, t in enumerate(tokens) if size == WINDOW or sum(map(is_wide, t)) >= WIDE_WINDOW // 2]
        if not texts:
            continue
        lengths = np.array([len(tokens[i]) for i in texts])
        last = np.cumsum(lengths)
        ends, owner, first = np.repeat(last, lengths), np.repeat(texts, lengths), np.repeat(last - lengths, lengths)
        code, value = templates.typed([w for i in texts for w in tokens[i]])
        at, template = templates.windows(code, ends, size)
        for w, keys in templates.keys(code, value, at, template, size):
            ok = bits.holds(keys)
            where = at[w[ok]]
            owners.append(owner[where]), places.append(where - first[where]), found.append(keys[ok])
    owner, place, key = np.concatenate(owners), np.concatenate(places).astype(np.int32), np.concatenate(found).view(np.int64)
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(tokens) + 1))
    rows = [i for i in range(len(tokens)) if cut[i + 1] - cut[i] >= 2]
    pick = lambda a: pd.Series([a[order[cut[i] : cut[i + 1]]] for i in rows], dtype=object)
    return pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[rows], "text": part["text"].to_numpy()[rows], "at": pick(place), "keys": pick(key)})


class Item:
    """An evaluation text to align with."""

    def __init__(self, tokens: list[str], templates: Templates):
        self.tokens = tokens
        self.wide = mostly_wide(tokens)
        self.k = 6 if self.wide else 3
        self.grams: dict[tuple, list[int]] = defaultdict(list)
        for i in range(len(tokens) - self.k + 1):
            self.grams[tuple(tokens[i : i + self.k])].append(i)
        code, value = templates.typed(tokens)
        self.slot = code <= NAME
        self.size = WIDE_WINDOW if self.wide else WINDOW
        at, template = templates.windows(code, np.full(len(code), len(code)), self.size)
        self.templates = set(next(templates.keys(code, value, at, template, self.size))[1].tolist())


def _ngram_runs(item: Item, tokens: list[str]) -> list[tuple[int, int, int]]:
    """(place in the text, begin, end in the item) of the longest runs of words that both hold."""
    k, grams = item.k, item.grams
    runs: dict[int, list[int]] = {}
    parts: list[tuple[int, int, int]] = []
    for j in range(len(tokens) - k + 1):
        for i in grams.get(tuple(tokens[j : j + k]), ()):
            d = j - i
            if d in runs and runs[d][1] == i - 1 + k:
                runs[d][1] = i + k
            else:
                if d in runs:
                    parts.append((d + runs[d][0], *runs[d]))
                runs[d] = [i, i + k]
    parts += [(d + r[0], *r) for d, r in runs.items()]
    return sorted(parts)


def _chain(item: Item, parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The parts, in order in both texts and with one foreign sentence between them at most, that hold most characters."""
    own = item.tokens
    at = np.r_[0, np.cumsum([len(w) for w in own])]
    foreign = FOREIGN * (2 if item.wide else 1)
    best: list[list[tuple[float, int, int]]] = []  # by foreign sentences used: (characters, part before, foreign sentences before it)
    top, end = 0.0, (0, 0)
    for s, (j0, a, b) in enumerate(parts):
        here = [(float(at[b] - at[a]), -1, 0), (-1.0, -1, 0)]
        for p in range(s - 1, -1, -1):
            pj, pa, pb = parts[p]
            gap = j0 - (pj + pb - pa)
            if gap > foreign:
                if j0 - pj > foreign + len(own) + 50:
                    break
                continue
            if a < pa or b <= pb or j0 < pj:
                continue
            skip = max(0, pb - a, -gap)
            if a + skip >= b:
                continue
            gain = float(at[b] - at[a + skip])
            jump = gap > SMALL_GAP
            for used in (0, 1):
                held = best[p][used][0]
                if held >= 0 and used + jump <= 1 and held + gain > here[used + jump][0]:
                    here[used + jump] = (held + gain, p, used)
        best.append(here)
        for used in (0, 1):
            if here[used][0] > top:
                top, end = here[used][0], (s, used)
    chain = []
    s, used = end
    while s >= 0:
        chain.append(parts[s])
        _, s, used = best[s][used]
    return chain[::-1]


def _beside(own: list[str], tokens: list[str], i: int, j: int, step: int, most: int) -> int:
    """How many words of the item go on from (i, j) in one direction, single altered words between kept ones included."""
    good = miss = n = 0
    while 0 <= i < len(own) and 0 <= j < len(tokens) and n < most:
        n += 1
        if own[i] == tokens[j]:
            good, miss = n, 0
        else:
            miss += 1
            if miss > 1:
                break
        i, j = i + step, j + step
    return good


def align(item: Item, tokens: list[str]) -> tuple[float, float]:
    """(share of the item's characters that the text holds in order, share of its slots there that agree).

    Words altered one by one between words that are kept count as held.
    """
    parts = _ngram_runs(item, tokens)
    if not parts:
        return 0.0, 0.0
    chain = _chain(item, parts)
    own = item.tokens
    held = np.zeros(len(own), bool)
    for n, (j, a, b) in enumerate(chain):
        following = chain[n + 1] if n + 1 < len(chain) else None
        back = _beside(own, tokens, a - 1, j - 1, -1, a - (chain[n - 1][2] if n else 0))
        on = _beside(own, tokens, b, j + b - a, 1, (following[1] if following else len(own)) - b)
        held[a - back : b + on] = True
        if following and 0 < following[1] - b <= 2 * item.k and following[0] - (j + b - a) <= following[1] - b + SMALL_GAP:
            held[b : following[1]] = True
    size = np.array([len(w) for w in own])
    near = set(tokens[max(0, chain[0][0] - chain[0][1] - FOREIGN) : chain[-1][0] + len(own) + FOREIGN])
    slots = [i for i in range(chain[0][1], chain[-1][2]) if item.slot[i]]
    return float(size[held].sum() / max(1, size.sum())), sum(own[i] in near for i in slots) / max(1, len(slots))


def _judge(frame, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates(frame.value)
        known: dict[int, Item] = {}
        for pdf in batches:
            found = []
            for doc, text, cands in zip(pdf["doc_id"], pdf["text"], pdf["cands"]):
                tokens = tokens_of(text)
                own: dict[int, set[int]] = {}
                for c in cands:
                    n = c["item_id"]
                    if n not in known:
                        if len(known) >= 5_000:
                            known.clear()
                        known[n] = Item(list(c["tokens"]), templates)
                    item = known[n]
                    held, slots = align(item, tokens) if c["agree"] >= 2 else (0.0, 0.0)
                    if held >= share and slots >= 0.5:
                        found.append((n, doc, held, slots, "passage"))
                    elif c["alike"] and slots < 0.5:
                        if item.size not in own:
                            code, value = templates.typed(tokens)
                            at, template = templates.windows(code, np.full(len(code), len(code)), item.size)
                            own[item.size] = set(next(templates.keys(code, value, at, template, item.size))[1].tolist())
                        if 2 * len(item.templates & own[item.size]) >= max(8, len(item.templates)):
                            found.append((n, doc, held, slots, "template"))
            yield pd.DataFrame(found, columns=["item_id", "doc_id", "share", "slots", "kind"])

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """Rows (item_id, doc_id, share, slots, kind), one for each document and evaluation text of which it holds a passage.

    kind is "passage" where at least `share` of the item's characters stand in the document in order (letter case, punctuation,
    spacing, encoding, single words, and one foreign sentence of up to FOREIGN words aside), and "template" where the document
    repeats at least half of the item's template windows, and four of them, with other values. Null, empty and very short texts of either side give
    no row; repeated documents each give theirs; an item_id delivered twice counts once; empty tables give no rows.

    The corpus is read once, whole; only windows that pass a filter of bounded size are shuffled, to meet the table of the items' windows. Of an item's
    templates those are looked up of which a text with half of them must hold one, the rarest first, so a wording that all items share brings no pairs.
    """
    spark = docs.sparkSession
    own = materialise(_item_tokens(items, item_col, item_text), "items")
    frame = spark.sparkContext.broadcast(common_wording(own))
    keys = materialise(_item_keys(own, frame), "item-windows")
    filled = keys.where("slots > 0").select("key", "item_id", "at", "slots")
    wanted = materialise(filled.unionByName(_rarest(keys.where("slots = 0")).select("key", "item_id", F.lit(-1).alias("at"), F.lit(0).alias("slots"))), "wanted")
    bits = spark.sparkContext.broadcast(filter_of(wanted))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    hits = materialise(_hits(src, frame, bits).withColumn("uid", F.monotonically_increasing_id()), "hits")
    each = hits.select("uid", F.explode(F.arrays_zip(F.col("at").alias("place"), "keys")).alias("x")).select("uid", "x.place", F.col("x.keys").alias("key"))
    met = each.join(wanted, "key").groupBy("uid", "item_id", "at", "slots", "place").agg(F.count("*").alias("n"))
    agree = (F.col("slots") > 0) & (F.col("n") >= F.greatest(F.lit(1), F.col("slots") - (F.col("slots") > 2).cast("int")))
    pairs = met.groupBy("uid", "item_id").agg(F.countDistinct(F.when(agree, F.col("at"))).alias("agree"), F.max(F.col("slots") == 0).alias("alike")).where("agree >= 2 or alike")
    packed = pairs.join(own.select("item_id", "tokens"), "item_id").groupBy("uid").agg(F.collect_list(F.struct("item_id", "agree", "alike", "tokens")).alias("cands"))
    return hits.select("uid", "doc_id", "text").join(packed, "uid").select("doc_id", "text", "cands").mapInPandas(_judge(frame, share), "item_id long, doc_id long, share double, slots double, kind string")
