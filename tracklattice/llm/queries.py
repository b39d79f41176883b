"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.llm import canonical, clusters, leaks, linkage, neighbours, representatives, sentences, tokens
from tracklattice.session import materialise, table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids of every document by the byte-level BPE of 50k tokens."""
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best key and tempo of each group of records of one recording."""
    src = table(spark, sf_dir, "registry_enrichment")
    bundles = {"k": [representatives.key_value()], "b": [representatives.tempo_value()]}
    best = representatives.best_records(src, representatives.record_groups(src), bundles)
    return best.select(
        F.col("id").alias("row_id"), F.coalesce(F.col("k")[0], F.lit("")).alias("canonical_key"), F.coalesce(F.col("b")[0].cast("long"), F.lit(0).cast("long")).alias("canonical_bpm")
    )


def p1_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives with further bundles: mood values belong together, and so do the main genre and the list it opens."""
    src = table(spark, sf_dir, "registry_enrichment")
    number = lambda c: F.when(F.col(c).rlike("^[01]([.][0-9]+)?$"), F.col(c))
    genre = F.when(F.trim("primary_genre") != "", F.trim("primary_genre"))
    bundles = {
        "canonical_key": [representatives.key_value()], "canonical_bpm": [representatives.tempo_value()], "mood": [number("danceability"), number("valence")],
        "main_genre": [genre], "genres": [F.when(F.size("all_genres") > 0, F.array_join("all_genres", "; "))],
    }
    return representatives.best_records(src, representatives.record_groups(src), bundles, dependencies=(("main_genre", "genres"),)).withColumnRenamed("id", "row_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a cosine of at least 0.97 in which one row is among the five most similar of the other, by either vector."""
    src = table(spark, sf_dir, "track_features")
    both = None
    for kind, column in (("embed", "embed_vector"), ("unified", "unified_vector")):
        pairs = neighbours.nearest_pairs(src, "track_index", column, k=5, least=0.97, dim=64, label=kind)
        both = pairs if both is None else both.unionByName(pairs)
    return both.select(
        F.col("kind").alias("vector_kind"), F.least("a", "b").alias("track_index_a"), F.greatest("a", "b").alias("track_index_b")
    ).distinct()


def p2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most similar rows, however similar, of the query set (every track_index divisible by 20) against all rows, by either vector."""
    src = table(spark, sf_dir, "track_features")
    both = None
    for kind, column in (("embed", "embed_vector"), ("unified", "unified_vector")):
        part = neighbours.nearest_to_queries(src, "track_index", column, src.where("track_index % 20 = 0"), k=5, dim=64, label=kind)
        both = part if both is None else both.unionByName(part)
    return both.select(F.col("kind").alias("vector_kind"), F.col("a").alias("track_index"), F.col("b").alias("neighbour"), F.round("similarity", 9).alias("similarity"), "place")


def genre_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the three genre columns that are neither null nor blank, with their place in the array."""
    out = None
    for name, key, column in (("playlist_tracks", "row_id", "genres"), ("registry_enrichment", "row_id", "all_genres"), ("dj_taxonomy_category", "category_no", "source_genres")):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("source_table"), F.col(key).cast("long").alias("row_id"), F.posexplode(column).alias("pos", "value"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("value").isNotNull() & ~F.col("value").rlike(r"^[\s\p{Z}\p{Cf}]*$")).withColumn("pos", F.col("pos").cast("long"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genre of the reference that each freely entered genre means, or -1."""
    reference = table(spark, sf_dir, "genre_reference")
    names = F.broadcast(reference.select(F.col("genre").alias("value")).distinct())  # the reference list is fixed
    entries = genre_entries(spark, sf_dir).join(names, "value", "left_anti")
    mapping = materialise(canonical.map_values(entries.select("value"), reference, "genre_id", "genre", "aliases"), "genres")
    return canonical.apply_mapping(entries, mapping).select("source_table", "row_id", "pos", F.col("entry").alias("genre_id"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of playlist rows and files with the confidence that they are one recording."""
    return linkage.linked_pairs(table(spark, sf_dir, "playlist_tracks"), table(spark, sf_dir, "file_entries"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of playlist rows and files of one recording: a confidence of 0.5, then the definition's own conditions (known durations within 3 seconds, one title)."""
    return p4_links(spark, sf_dir).where((F.col("confidence") >= 0.5) & F.col("exact")).select("row_id", "file_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cluster of unified_vector with the cluster's medoid."""
    got = clusters.similarity_clusters(table(spark, sf_dir, "track_features"), "track_index", "unified_vector", dim=64)
    return got.select("medoid_index", "member_index")


def p5_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and five most typical members of each cluster."""
    return clusters.typical_members(clusters.similarity_clusters(table(spark, sf_dir, "track_features"), "track_index", "unified_vector", dim=64))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items and the documents that hold at least half of their text."""
    got = leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return got.where(F.col("kind") == "passage").select("item_id", "doc_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks with the share held: passages, and questions asked again with other values (kind template)."""
    got = leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return got.select("item_id", "doc_id", F.round("share", 6).alias("share"), F.round("slots", 6).alias("slots"), "kind").distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of all sentences of all documents."""
    docs = table(spark, sf_dir, "documents")
    return sentences.split_sentences(docs, sentences.learn(docs)).withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_bundles": p1_bundles, "p2_found": p2_found, "p2_topk": p2_topk, "p3_found": p3_found, "p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p5_typical": p5_typical, "p6_ids": p6_ids, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found}
ORACLES: dict[str, str] = {}
