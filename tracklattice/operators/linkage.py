"""Deterministic linkage: key cascades, unique keys, tolerance bands, token matching, set semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[tuple[str, float, list[tuple[Column, Column]], Column | None]]) -> DataFrame:
    """One row per left row: the right row of the first pass that finds one, with its method and score; method "new" without any.

    A pass is (name, score, equal pairs of a left and a right expression, further condition over the columns of both sides, left ones under l_ and
    right ones under r_). Among several right rows the smallest id counts. Null keys match nothing.
    """
    lhs = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    rhs = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    open_, found = lhs, None
    for name, score, equal, further in passes:
        cond = F.lit(True)
        for a, b in equal:
            cond = cond & (a == b)
        met = open_.join(rhs, cond, "inner")
        if further is not None:
            met = met.where(further)
        hit = met.groupBy(F.col(f"l_{left_id}").alias(left_id)).agg(F.min(f"r_{right_id}").alias(right_id)).withColumn("method", F.lit(name)).withColumn("score", F.lit(score))
        found = hit if found is None else found.unionByName(hit)
        open_ = open_.join(hit.select(F.col(left_id).alias(f"l_{left_id}")), f"l_{left_id}", "left_anti")
    rest = open_.select(F.col(f"l_{left_id}").alias(left_id), F.lit(None).cast(right.schema[right_id].dataType).alias(right_id), F.lit("new").alias("method"), F.lit(1.0).alias("score"))
    return found.unionByName(rest) if found is not None else rest


def unique_key_match(left: DataFrame, right: DataFrame, keys: list[str], right_id: str) -> DataFrame:
    """left with the id of the right row of the same key, null where the key is missing or stands for several right rows."""
    single = right.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(right_id).alias(right_id)).where("__n = 1").drop("__n")
    return left.join(single, keys, "left")


def band_pairs(rows: DataFrame, group: str, id_col: str, value: str, width: float) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of one group whose values differ by at most width.

    Values are cut into bands of that width and a row meets its own and the next band only: the join is an equi-join on (group,
    band), and a group of any size splits into its bands.
    """
    a = rows.where(F.col(value).isNotNull()).select(group, F.col(id_col).alias("id_a"), F.col(value).alias("v_a"), F.floor(F.col(value) / width).alias("band"))
    b = rows.where(F.col(value).isNotNull()).select(group, F.col(id_col).alias("id_b"), F.col(value).alias("v_b"), F.explode(F.array(F.floor(F.col(value) / width), F.floor(F.col(value) / width) - 1)).alias("band"))
    met = a.join(b, [group, "band"]).where((F.col("id_a") != F.col("id_b")) & (F.abs(F.col("v_a") - F.col("v_b")) <= width))
    return met.select(group, F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def token_matches(queries: DataFrame, query_id: str, query_tokens: str, docs: DataFrame, doc_id: str, doc_tokens: str) -> DataFrame:
    """Rows (query_id, doc_id, common, coverage): documents that share a word with a query, over an inverted index.

    coverage is the share of the query's distinct words that the document holds. Pairs that share no word do not come out.
    """
    q = queries.select(query_id, F.array_distinct(query_tokens).alias("t")).withColumn("n", F.size("t"))
    left = q.select(query_id, "n", F.explode("t").alias("token"))
    right = docs.select(doc_id, F.explode(F.array_distinct(doc_tokens)).alias("token"))
    both = left.join(right, "token").groupBy(query_id, doc_id).agg(F.count("*").alias("common"), F.first("n").alias("n"))
    return both.select(query_id, doc_id, "common", (F.col("common") / F.col("n")).alias("coverage"))


def _pair_keys(words: Column) -> Column:
    """Hashes of all pairs of a sorted array of words."""
    place = F.sequence(F.lit(0), F.size(words) - 1)
    pairs = F.flatten(F.transform(place, lambda i: F.transform(F.filter(place, lambda j: j > i), lambda j: F.xxhash64(F.get(words, i), F.get(words, j)))))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<bigint>"))


def best_match(
    queries: DataFrame, query_id: str, title: str, artist: str, files: DataFrame, file_id: str, file_tokens: str, file_title: str, least: float = 0.62
) -> DataFrame:
    """Rows (query_id, file_id, score): the best file of each query that has one with a score of at least `least` (0.6 or more).

    The score is the coverage of the title words by the file's title (or all its words, at 0.85), times 0.7, plus 0.2 where a word of
    the artist is there, half of it otherwise; full coverage gives 0.95 with the artist, 0.9 without from three words on, else 0.45. The
    smallest file id wins ties.

    Such a score needs a file that holds the share (least - 0.2) / 0.7 of the title's words, two of them at least (one and a word of the
    artist where the title has one). Of the rarest words of a title, as many as may be missing and two more, two must be there: files are
    looked up by those pairs, so words that fill the library bring nothing together. Queries of the same words are matched once.
    """
    if least < 0.6:
        raise ValueError("pairs of words find every match only from a score of 0.6 on")
    share = (least - 0.2) / 0.7
    q = queries.select(query_id, F.array_sort(F.array_distinct(title)).alias("q_t"), F.array_sort(F.array_distinct(artist)).alias("q_a")).where(F.size("q_t") > 0).withColumn("q", F.xxhash64("q_t", "q_a"))
    classes = q.groupBy("q").agg(F.first("q_t").alias("q_t"), F.first("q_a").alias("q_a"))
    held = files.select(file_id, F.array_sort(F.array_distinct(file_tokens)).alias("f_w"))
    frequency = held.select(F.explode("f_w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = classes.select("q", F.size("q_t").alias("size"), F.explode("q_t").alias("token")).join(frequency, "token", "left")
    w = Window.partitionBy("q").orderBy(F.coalesce("n", F.lit(0)), "token")
    rare = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 2)
    picked = rare.groupBy("q").agg(F.array_sort(F.collect_list("token")).alias("r")).join(classes, "q")
    of_artist = F.array_distinct(F.transform(F.array_except("q_a", "q_t"), lambda x: F.xxhash64(F.least(x, F.col("q_t")[0]), F.greatest(x, F.col("q_t")[0]))))
    keys = picked.select("q", F.explode(F.when(F.size("q_t") == 1, of_artist).otherwise(_pair_keys(F.col("r")))).alias("key"))
    met = keys.join(held.select(file_id, F.explode(_pair_keys(F.col("f_w"))).alias("key")), "key").select("q", file_id).distinct()
    f = files.select(file_id, F.array_distinct(file_tokens).alias("f_all"), F.array_distinct(file_title).alias("f_t"))
    both = met.join(classes, "q").join(f, file_id)
    size = F.size("q_t")
    in_title = F.size(F.array_intersect("q_t", "f_t")) / size
    anywhere = F.size(F.array_intersect("q_t", "f_all")) / size
    artist_there = (F.size("q_a") > 0) & F.arrays_overlap("q_a", "f_all")
    partial = F.greatest(in_title, anywhere * 0.85) * 0.7
    score = F.when(in_title >= 0.999, F.when(artist_there, 0.95).when(size >= 3, 0.9).otherwise(0.45)).otherwise(F.when(artist_there, partial + 0.2).otherwise(partial * 0.5))
    scored = both.select("q", file_id, F.round(score, 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(file_id).alias("f"))).alias("x"))
    return q.select(query_id, "q").join(best, "q").select(query_id, F.col("x.f").alias(file_id), (-F.col("x.s")).alias("score"))


def best_cut(
    queries: DataFrame, query_id: str, title: str, artist: str, remixer: str, files: DataFrame, file_id: str, file_tokens: str, file_title: str, least: float = 0.62
) -> DataFrame:
    """Rows (query_id, file_id, score) as best_match gives them, over the core words of the title, a remix being a recording of its own.

    Core words are those of the title without the words of remixer and artist and without "remix" (all of them where none is left). The score
    is at most 0.45 where the title has a remixer of whom the file's title has no word, and where the file's title says "remix" and the
    query's does not. From three words of the whole title on, full coverage gives 0.9 without the artist.

    Files are looked up by pairs of the rarest core words as in best_match. A single core word meets files with a word of the remixer, or
    else of the artist; beside these, of all files that hold it and count the same the smallest id alone can be best.
    """
    if least < 0.6:
        raise ValueError("pairs of words find every match only from a score of 0.6 on")
    share = (least - 0.2) / 0.7
    fields = ("q_t", "q_a", "q_r", "q_c")
    core = F.array_except(F.array_except(F.array_except("q_t", "q_r"), "q_a"), F.array(F.lit("remix")))
    q = queries.select(query_id, *[F.array_sort(F.array_distinct(c)).alias(n) for c, n in ((title, "q_t"), (artist, "q_a"), (remixer, "q_r"))]).where(F.size("q_t") > 0)
    q = q.withColumn("q_c", F.when(F.size(core) > 0, core).otherwise(F.col("q_t"))).withColumn("q", F.xxhash64("q_t", "q_a", "q_r"))
    classes = q.groupBy("q").agg(*[F.first(c).alias(c) for c in fields])
    f = files.select(file_id, F.array_distinct(file_tokens).alias("f_all"), F.array_distinct(file_title).alias("f_t"))
    held = f.select(file_id, F.array_sort(F.array_union("f_all", "f_t")).alias("f_w"), "f_all", "f_t")
    frequency = held.select(F.explode("f_w").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    ranked = classes.where(F.size("q_c") > 1).select("q", F.size("q_c").alias("size"), F.explode("q_c").alias("token")).join(frequency, "token", "left")
    w = Window.partitionBy("q").orderBy(F.coalesce("n", F.lit(0)), "token")
    rare = ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 2)
    of_words = rare.groupBy("q").agg(F.array_sort(F.collect_list("token")).alias("r")).select("q", F.explode(_pair_keys(F.col("r"))).alias("key"))
    one = classes.where(F.size("q_c") == 1).withColumn("word", F.get("q_c", F.lit(0)))
    others = F.array_except(F.when(F.size("q_r") > 0, F.col("q_r")).otherwise(F.col("q_a")), "q_c")
    of_names = one.select("q", F.explode(F.transform(others, lambda x: F.xxhash64(F.least(x, "word"), F.greatest(x, "word")))).alias("key"))
    met = of_words.unionByName(of_names).join(held.select(file_id, F.explode(_pair_keys(F.col("f_w"))).alias("key")), "key").select("q", file_id)
    word = F.col("token")
    first = held.select(file_id, "f_all", "f_t", F.explode("f_w").alias("token")).groupBy(
        word.alias("word"), F.array_contains("f_t", word).alias("in_title"), F.array_contains("f_all", word).alias("in_all"), F.array_contains("f_t", "remix").alias("remix")
    ).agg(F.min(file_id).alias(file_id))
    met = met.unionByName(one.where(F.size("q_r") == 0).join(first, "word").select("q", file_id)).distinct()
    both = met.join(classes, "q").join(f, file_id)
    size = F.size("q_c")
    in_title = F.size(F.array_intersect("q_c", "f_t")) / size
    anywhere = F.size(F.array_intersect("q_c", "f_all")) / size
    artist_there = (F.size("q_a") > 0) & F.arrays_overlap("q_a", "f_all")
    partial = F.greatest(in_title, anywhere * 0.85) * 0.7
    score = F.when(in_title >= 0.999, F.when(artist_there, 0.95).when(F.size("q_t") >= 3, 0.9).otherwise(0.45)).otherwise(F.when(artist_there, partial + 0.2).otherwise(partial * 0.5))
    other_cut = F.when(F.size("q_r") > 0, ~F.arrays_overlap("q_r", "f_t")).otherwise(False) | (F.array_contains("f_t", "remix") & ~F.array_contains("q_t", "remix"))
    scored = both.select("q", file_id, F.round(F.when(other_cut, F.least(score, F.lit(0.45))).otherwise(score), 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(file_id).alias("f"))).alias("x"))
    return q.select(query_id, "q").join(best, "q").select(query_id, F.col("x.f").alias(file_id), (-F.col("x.s")).alias("score"))


def superseded(marked: DataFrame, marked_id: str, marked_tokens: str, plain: DataFrame, plain_id: str, plain_tokens: str) -> DataFrame:
    """Ids of marked rows all of whose words occur in one plain row of another id.

    Rows of the same words are one class on either side. Plain classes are found over the rarest word of each marked class, so no
    pair is looked at that cannot hold.
    """
    p = plain.select(F.col(plain_id).alias("p_id"), F.array_sort(F.array_distinct(plain_tokens)).alias("p_t"))
    p = p.groupBy("p_t").agg(F.min("p_id").alias("lo"), F.max("p_id").alias("hi")).withColumn("p_c", F.xxhash64("p_t"))
    m = marked.select(F.col(marked_id), F.array_sort(F.array_distinct(marked_tokens)).alias("m_t")).where(F.size("m_t") > 0).withColumn("m_c", F.xxhash64("m_t"))
    sets = m.groupBy("m_c").agg(F.first("m_t").alias("m_t"))
    index = p.select("p_c", F.explode("p_t").alias("token"))
    freq = index.groupBy("token").agg(F.count("*").alias("n"))
    each = sets.select("m_c", F.explode("m_t").alias("token")).join(freq, "token", "left")
    rarest = each.groupBy("m_c").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x")).where("x.n > 0").select("m_c", F.col("x.token").alias("token"))
    held = rarest.join(index, "token").join(sets, "m_c").join(p, "p_c").where(F.size(F.array_except("m_t", "p_t")) == 0)
    span = held.groupBy("m_c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return m.join(span, "m_c").where((F.col("lo") != F.col(marked_id)) | (F.col("hi") != F.col(marked_id))).select(marked_id).distinct()


def superseded_cut(marked: DataFrame, marked_id: str, plain: DataFrame, plain_id: str, title_tokens: str, all_tokens: str, same_cut: tuple[tuple[str, ...], tuple[str, ...]]) -> DataFrame:
    """Ids of marked rows beside which a plain row of another id has the same title and artists.

    Words of same_cut are left aside in a title that has one of its first and one of its second, such as "original mix"; one alone may belong to the title.

    Over sets of words a further artist who is named in the title adds nothing to them, so the rule of equal titles and a subset of the
    artists is the equality of both sets: a remix never stands for the original, nor another artist's title for this one.
    """
    any_of = lambda words: F.array(*[F.lit(w) for w in words])
    said = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    same = F.arrays_overlap(said(title_tokens), any_of(same_cut[0])) & F.arrays_overlap(said(title_tokens), any_of(same_cut[1]))
    words = lambda c: F.array_sort(F.when(same, F.array_except(said(c), any_of([*same_cut[0], *same_cut[1]]))).otherwise(F.array_distinct(said(c))))
    key = F.xxhash64(words(title_tokens), F.array_sort(F.array_except(words(all_tokens), words(title_tokens))))
    span = plain.where(F.size(words(title_tokens)) > 0).groupBy(key.alias("key")).agg(F.min(plain_id).alias("lo"), F.max(plain_id).alias("hi"))
    m = marked.where(F.size(words(title_tokens)) > 0).select(marked_id, key.alias("key")).join(span, "key")
    return m.where((F.col("lo") != F.col(marked_id)) | (F.col("hi") != F.col(marked_id))).select(marked_id).distinct()


def closest(left: DataFrame, left_id: str, left_key: str, left_value: str, right: DataFrame, right_id: str, right_key: str, right_value: str, tolerance: float) -> DataFrame:
    """For each left row the right row of the same key with the nearest value within the tolerance, the smaller id on ties.

    Values meet by bands as wide as the tolerance, so a key that many rows share is cut into its bands; right rows of one value are
    one row before they meet.
    """
    band = lambda c: F.floor(F.col(c) / tolerance)
    a = left.where(F.col(left_value).isNotNull()).select(F.col(left_id), F.col(left_key).alias("__k"), F.col(left_value).alias("__x"), F.explode(F.array(band(left_value) - 1, band(left_value), band(left_value) + 1)).alias("__b"))
    b = right.where(F.col(right_value).isNotNull()).groupBy(F.col(right_key).alias("__k"), F.col(right_value).alias("__y")).agg(F.min(right_id).alias(right_id)).withColumn("__b", F.floor(F.col("__y") / tolerance))
    gap = F.abs(F.col("__x") - F.col("__y"))
    met = a.join(b, ["__k", "__b"]).where(gap <= tolerance)
    return met.groupBy(left_id).agg(F.min(F.struct(F.round(gap, 6).alias("gap"), F.col(right_id).alias("r"))).alias("x")).select(left_id, F.col("x.r").alias(right_id), F.col("x.gap").alias("gap"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__p", F.row_number().over(w)).where("__p = 1").drop("__p")


def nearest_in_group(queries: DataFrame, query_id: str, hits: DataFrame, hit_id: str, group: str, value: str, band: float = 5.0) -> DataFrame:
    """Rows (query_id, hit_id, gap): for each query the hit of its group with the nearest value, the smaller id on ties; queries without a hit, group or
    value give none.

    Values are cut into bands. A query meets the neighbours in its own band, and the last and first hit of the nearest bands with hits on either side,
    which one row a band tells; no pair of a group is formed, and a group of any size is as many tasks as it has bands.
    """
    at = F.floor(F.col(value) / F.lit(band))
    h = hits.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.min(hit_id).alias("__hit")).withColumn("__band", at).withColumn("__x", F.struct(F.col(value).alias("v"), F.col("__hit").alias("h")))
    q = queries.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(query_id, group, value, at.alias("__band"))
    edges = h.groupBy(group, "__band").agg(F.min("__x").alias("low"), F.max("__x").alias("high"))
    bands = q.select(group, "__band").distinct().join(edges, [group, "__band"], "full")
    w = Window.partitionBy(group).orderBy("__band")
    around = bands.select(
        group, "__band", F.last("high", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.first("low", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__after")
    )
    none = F.lit(None).cast(queries.schema[query_id].dataType)
    both = q.select(query_id, group, "__band", value, F.lit(None).cast(h.schema["__x"].dataType).alias("__x")).unionByName(h.select(none.alias(query_id), group, "__band", value, "__x"))
    inner = Window.partitionBy(group, "__band").orderBy(value)
    near = both.select(
        query_id, group, "__band", value, F.last("__x", True).over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("__own_before"), F.first("__x", True).over(inner.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("__own_after")
    ).where(F.col(query_id).isNotNull()).join(around, [group, "__band"])
    gap = lambda x: F.struct(F.round(F.abs(x["v"] - F.col(value)), 6).alias("gap"), x["h"].alias("h"))
    said = F.array_sort(F.transform(F.array_compact(F.array(*[F.col(c) for c in ("__own_before", "__own_after", "__before", "__after")])), gap))
    return near.select(query_id, F.get(said, F.lit(0)).alias("x")).where("x is not null").select(query_id, F.col("x.h").alias(hit_id), F.col("x.gap").alias("gap"))
