"""Classification against a taxonomy: phrases, weighted evidence, scores by level, selection, feature maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklattice.functions import text

# fixed values: thresholds of the selection
MIN_FAMILY, MIN_MARGIN = 0.25, 0.06


def phrase_hits(docs: DataFrame, doc_id: str, text_col: str, labels: DataFrame, label_id: str, label: str) -> DataFrame:
    """Rows (doc_id, label_id, hits): how often a label's words stand in a document as a phrase.

    Both sides are cut into lower-case words of a to z and digits; a document is exploded into runs of as many words as labels
    have, and only runs that are labels leave the join (the labels are broadcast where Spark finds them small).
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    cut = labels.select(label_id, words(F.col(label)).alias("w")).where(F.size("w") > 0)
    lengths = sorted(r["n"] for r in cut.select(F.size("w").alias("n")).distinct().collect())  # as many rows as labels have lengths
    key = cut.select(label_id, F.array_join("w", " ").alias("phrase"))
    w = docs.where(F.col(text_col).isNotNull()).select(doc_id, words(F.col(text_col)).alias("w"))
    runs = w.select(doc_id, F.explode(F.concat(*[text.ngrams(F.col("w"), n) for n in lengths] or [F.array().cast("array<string>")])).alias("phrase"))
    return runs.join(key, "phrase").groupBy(doc_id, label_id).agg(F.count("*").alias("hits"))


def level_scores(evidence: DataFrame, id_col: str, family: str, genre: str, weight: str) -> DataFrame:
    """Rows (id, family, genre, family_score, genre_score): evidence added up on both levels; the family gets 0.30 of a genre's weight."""
    genres = evidence.groupBy(id_col, family, genre).agg(F.sum(weight).alias("genre_score"))
    families = genres.groupBy(id_col, family).agg(F.sum(F.col("genre_score") * F.lit("0.30").cast("decimal(4,2)")).alias("family_score"))
    return genres.join(families, [id_col, family])


# fixed values: what an item of evidence adds to family, genre and subgenre, by the deepest level it names; broad subgenres named letter for letter add less
SHARES = {"family": (1.0, 0.0, 0.0), "genre": (0.30, 1.0, 0.0), "subgenre": (0.22, 0.52, 1.0), "broad": (0.28, 0.78, 0.42)}


def path_scores(evidence: DataFrame, id_col: str, family: str, genre: str, subgenre: str, delta: str, broad: str | None = None) -> DataFrame:
    """Rows (id, family, genre, subgenre, score): evidence added up on three levels; genre and subgenre are null on the levels above theirs.

    An item without a genre counts for its family, one without a subgenre for genre and family, by SHARES; items without a family or of a delta of 0 or
    less count for nothing. Each item becomes a row a level before they are added up.
    """
    f, g, s = F.col(family), F.col(genre), F.col(subgenre)
    level = F.when(g.isNull(), "family").when(s.isNull(), "genre").when(F.coalesce(F.col(broad), F.lit(False)) if broad else F.lit(False), "broad").otherwise("subgenre")
    share = lambda i: F.create_map(*[F.lit(x) for k, v in SHARES.items() for x in (k, v[i])])[level]
    nothing = F.lit(None).cast("string")
    rows = F.array(
        F.struct(f.alias("family"), nothing.alias("genre"), nothing.alias("subgenre"), (F.col(delta) * share(0)).alias("score")), F.struct(f.alias("family"), g.alias("genre"), nothing.alias("subgenre"), (F.col(delta) * share(1)).alias("score")),
        F.struct(f.alias("family"), g.alias("genre"), s.alias("subgenre"), (F.col(delta) * share(2)).alias("score")),
    )
    each = evidence.where(f.isNotNull() & (F.col(delta) > 0)).select(id_col, F.explode(rows).alias("x")).select(id_col, "x.*").where("score > 0")
    return each.groupBy(id_col, "family", "genre", "subgenre").agg(F.round(F.sum("score"), 6).alias("score"))


def deepest_path(scores: DataFrame, id_col: str, least: tuple[float, float, float] = (0.25, 0.26, 0.26)) -> DataFrame:
    """Rows (id, family, genre, subgenre, family_score): from path_scores the best family of at least least[0], inside it the best genre of at least least[1],
    inside that the best subgenre of at least least[2]; levels that miss their threshold are null, ties go to the first name."""
    best = lambda name: F.min_by(F.struct(name, "score"), F.struct((-F.col("score")).alias("s"), name))
    top = scores.where("genre is null and score >= %f" % least[0]).groupBy(id_col).agg(best("family").alias("x")).select(id_col, F.col("x.family").alias("family"), F.col("x.score").alias("family_score"))
    second = scores.where("genre is not null and subgenre is null and score >= %f" % least[1]).groupBy(id_col, "family").agg(best("genre")["genre"].alias("genre"))
    third = scores.where("subgenre is not null and score >= %f" % least[2]).groupBy(id_col, "family", "genre").agg(best("subgenre")["subgenre"].alias("subgenre"))
    ids = scores.select(id_col).distinct()
    return ids.join(top, id_col, "left").join(second, [id_col, "family"], "left").join(third, [id_col, "family", "genre"], "left").select(id_col, "family", "genre", "subgenre", "family_score")


def selection(scores: DataFrame, id_col: str, family: str, genre: str) -> DataFrame:
    """Rows (id, family, genre, score, margin, warning): the best family by its score and 0.22 of its best genre's, then that genre.

    margin is the gap to the next family; "unclassified" under MIN_FAMILY. warning marks two strong families close together.
    """
    per_family = scores.groupBy(id_col, family).agg(
        (F.max("family_score").cast("double") + F.max("genre_score").cast("double") * 0.22).alias("total"),
        F.min(F.struct((-F.col("genre_score")).alias("s"), F.col(genre).alias("g"))).alias("best"),
    ).withColumn("total", F.round("total", 6))
    w = Window.partitionBy(id_col).orderBy(F.desc("total"), family)
    ranked = per_family.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("total").over(w)).where("place = 1")
    strong = F.coalesce((F.col("total") >= 0.75) & (F.col("next") >= 0.60) & (F.col("total") - F.col("next") < 0.22), F.lit(False))
    enough = F.col("total") >= MIN_FAMILY
    return ranked.select(
        id_col, F.when(enough, F.col(family)).otherwise(F.lit("unclassified")).alias(family), F.when(enough, F.col("best.g")).alias(genre), F.col("total").alias("score"),
        F.round(F.col("total") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"), strong.alias("warning"),
    )


def feature_map(rows: DataFrame, id_col: str, text_columns: list[str], number_columns: list[str], stop: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, features MAP): presence of words and word pairs of the text columns, and the values of the number columns."""
    words = [text.tokens(F.col(c), 2, stop) for c in text_columns]
    said = F.array_distinct(F.concat(*[p for w in words for p in (w, text.ngrams(w, 2))])) if words else F.array().cast("array<string>")
    numbers = F.filter(F.array(*[F.struct(F.lit(f"={c}").alias("key"), F.col(c).cast("double").alias("value")) for c in number_columns]), lambda x: x["value"].isNotNull())
    every = F.concat(F.transform(said, lambda k: F.struct(k.alias("key"), F.lit(1.0).alias("value"))), numbers)
    return rows.select(id_col, F.map_from_entries(every).alias("features"))


def resolved_aliases(aliases: DataFrame, name: str, target: str, rounds: int = 20) -> DataFrame:
    """Rows (name, target) with every chain of aliases followed to its end; a cycle raises an error."""
    cur = aliases.select(name, target)
    for _ in range(rounds):
        nxt = cur.alias("a").join(aliases.select(F.col(name).alias("__n"), F.col(target).alias("__t")), F.col(target) == F.col("__n"), "left")
        cur = nxt.select(F.col(f"a.{name}").alias(name), F.coalesce("__t", f"a.{target}").alias(target), F.col("__t").isNotNull().alias("moved"))
        if not cur.where("moved").limit(1).count():
            return cur.drop("moved")
        cur = cur.drop("moved")
    raise ValueError("aliases form a cycle")
