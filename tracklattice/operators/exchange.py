"""What goes out of the catalogue and comes back: reviews, observations, tagger results, cue points, comment lines, better copies, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklattice.functions import codes
from tracklattice.functions.music import camelot

# fixed values: seconds within which two cue points are one, confidence under which a cue is doubtful, seconds at the end of a track
SAME_TIME, LOW_CONFIDENCE, NEAR_END = 0.001, 0.55, 10.0
CUE_SCHEMA = "cue-grid-1"


def reviewed(queue: DataFrame, tracks: DataFrame, track_id: str = "track_id") -> DataFrame:
    """queue (track id, decision, suggested, chosen) with outcome ("accepted", "overridden", "skipped") and key.

    accept takes the suggested key, override the reviewer's in any notation; blank and unknown decisions, unknown tracks and keys that cannot be read are
    skipped. Rows that are not skipped are the manual observations to append.
    """
    said = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    suggested, chosen = F.when(F.trim("suggested") != "", F.col("suggested")), camelot(F.col("chosen"))
    known = queue.join(tracks.select(track_id).distinct().withColumn("__known", F.lit(True)), track_id, "left")
    outcome = (
        F.when(F.col("__known").isNull(), "skipped").when((said == "accept") & suggested.isNotNull(), "accepted").when((said == "override") & chosen.isNotNull(), "overridden").otherwise("skipped")
    )
    out = known.withColumn("outcome", outcome).drop("__known")
    return out.withColumn("key", F.when(F.col("outcome") == "accepted", suggested).when(F.col("outcome") == "overridden", chosen))


def observations(rows: DataFrame, source: str, file_id: str, key: str, others: list[str]) -> DataFrame:
    """rows with observation_id and the key in wheel notation; only rows with a key or any other field filled."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    read = camelot(F.col(key))
    some = read.isNotNull()
    for c in others:
        some = some | filled(c)
    name = F.concat(F.lit("OBS-"), F.regexp_replace(F.col(source), "analysis_", ""), F.lit("-"), F.col(file_id))
    return rows.where(some).withColumn("observation_id", name).withColumn(key, F.coalesce(read, F.lit("")))


def with_tagger_result(rows: DataFrame, missing: Column) -> DataFrame:
    """rows (energy, key, bpm, mood, vocal and the same with new_) after a tagger's result: energy, key and tempo where `missing` holds and the result has
    them, the tempo only where there is none; mood and vocal profile always, as codes."""
    take = lambda c: F.when(missing & F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c))
    bpm = F.when(missing & F.col("bpm").isNull() & (F.col("new_bpm") > 0), F.round("new_bpm").cast("int")).otherwise(F.col("bpm"))
    mood = F.when(F.col("new_mood").isNotNull(), codes.mood_code(F.col("new_mood"))).otherwise(F.col("mood"))
    vocal = codes.vocal_code(F.col("new_vocal"))
    fresh = {"energy": take("energy"), "key": take("key"), "bpm": bpm, "mood": mood, "vocal": F.when(vocal != "", vocal).otherwise(F.col("vocal"))}
    return rows.select(*[c for c in rows.columns if c not in fresh and not c.startswith("new_")], *[v.alias(k) for k, v in fresh.items()])


def cue_grid(rows: DataFrame, id_col: str, order: str, time: str) -> DataFrame:
    """Rows (id, payload): the bar times of an entity, in order, as JSON with the name of its schema."""
    times = rows.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(time).alias("t")))), lambda x: x["t"]).alias("bars"))
    return times.select(id_col, F.to_json(F.struct(F.lit(CUE_SCHEMA).alias("schema"), "bars")).alias("payload"))


def cue_grid_read(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    """Rows (id, place, time) of payloads of the right schema; empty grids, other schemas and broken text give none."""
    read = F.from_json(payload, "schema STRING, bars ARRAY<DOUBLE>")
    grid = rows.select(id_col, read.alias("g")).where((F.col("g.schema") == CUE_SCHEMA) & (F.size("g.bars") > 0))
    return grid.select(id_col, F.posexplode("g.bars").alias("place", "time"))


def is_automatic(source: Column) -> Column:
    """A cue point that an analysis made."""
    return F.coalesce(source.startswith("auto"), F.lit(False))


def cue_statuses(cues: DataFrame, marks: DataFrame, known: DataFrame, policy: str = "insert", dry_run: bool = False) -> DataFrame:
    """cues (cue_id, track_id, kind, num, start, end, name) with the status of writing them among the marks (track_id, type, num, start, end, name) of the
    tracks `known`: unmatched, review_only, invalid, skipped_conflict, replaced or inserted, with would_ in front of the last two on a dry run.

    A hot cue meets the mark of its number, a memory cue one at its start, a loop one at its start and end, within SAME_TIME. With the policy
    "replace-generated" a mark of the same name is the tool's own and is replaced. Starts are compared in equal steps, so no cue meets all marks of a track.
    """
    step = lambda c: F.floor(c / F.lit(SAME_TIME))
    kind = F.lower(F.trim("kind"))
    valid = F.when(kind == "hot", F.col("num").between(0, 7)).when(kind == "memory", F.col("num") == -1).when(kind == "loop", (F.col("num") == -1) & (F.col("end") > F.col("start"))).otherwise(False)
    slot = F.when(kind == "hot", F.array(F.concat(F.lit("h"), F.col("num").cast("string")))).otherwise(
        F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.concat(F.when(kind == "loop", "l").otherwise("m"), (step(F.col("start")) + d).cast("string")))
    )
    own = F.coalesce(F.col("num"), F.lit(-1))
    mark_slot = F.when(F.col("type") == 4, F.concat(F.lit("l"), step(F.col("start")).cast("string"))).when(own >= 0, F.concat(F.lit("h"), own.cast("string"))).otherwise(F.concat(F.lit("m"), step(F.col("start")).cast("string")))
    at = marks.select("track_id", mark_slot.alias("slot"), F.col("start").alias("m_start"), F.col("end").alias("m_end"), F.col("name").alias("m_name"))
    near = F.when(kind == "hot", True).otherwise((F.abs(F.col("start") - F.col("m_start")) <= SAME_TIME) & ((kind == "memory") | (F.abs(F.col("end") - F.col("m_end")) <= SAME_TIME)))
    met = cues.withColumn("slot", F.explode(slot)).join(at, ["track_id", "slot"]).where(near).groupBy("cue_id").agg(F.min(F.col("m_name") == F.col("name")).alias("generated"))
    dry = "would_" if dry_run else ""
    written = F.when(F.col("generated").isNull(), f"{dry}insert" if dry_run else "inserted").when(F.lit(policy == "replace-generated") & F.col("generated"), f"{dry}replace" if dry_run else "replaced").otherwise("skipped_conflict")
    both = cues.join(known.select("track_id").distinct().withColumn("__known", F.lit(True)), "track_id", "left").join(met, "cue_id", "left")
    status = F.when(F.col("__known").isNull(), "unmatched").when(F.lit(policy == "review-only"), "review_only").when(~F.coalesce(valid, F.lit(False)), "invalid").otherwise(written)
    return both.withColumn("status", status).drop("__known", "generated")


def cue_flags(confidence: Column, reason: Column, kind: Column, role: Column, end: Column, length: Column, status: Column) -> Column:
    """Names of the doubts about a cue point, in a fixed order."""
    said = lambda word: F.coalesce(F.contains(reason, F.lit(word)), F.lit(False))
    loop = kind == "loop"
    flags = [
        (confidence < LOW_CONFIDENCE, "low_confidence"), (said("fallback") | said("no_bar_grid"), "fallback_used"), (role.isin("peak", "outro_start") & said("fallback"), "missing_section"), (loop & said("short_loop"), "short_loop"),
        (loop & (length > 0) & (end >= F.greatest(F.lit(0.0), length - NEAR_END)), "loop_near_track_end"), (said("adjusted"), "cue_order_adjusted"), (said("possible_grid_offset"), "possible_grid_offset"), (status == "skipped_conflict", "export_conflict"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in flags]))


def line_changes(files: DataFrame, lines: DataFrame, track_id: str = "track_id") -> DataFrame:
    """files (track id, comment) with the new line and action: "write" where it differs, "same", or "no line" for unknown tracks and those without one."""
    both = files.join(lines.select(track_id, "line"), track_id, "left")
    return both.withColumn("action", F.when(F.coalesce("line", F.lit("")) == "", "no line").when(F.col("comment").eqNullSafe(F.col("line")), "same").otherwise("write"))


def upgrade_verdicts(present: DataFrame, checked: DataFrame, offers: DataFrame) -> DataFrame:
    """present (track, stem, tier, cut) with the verdict on looking for a better copy: "best already" at the highest tier, "checked before" for the same
    stem, "not found" without an offer, "other cut", "no upgrade", or "upgrade"; offers (track, offer, tier, cut): the one of the highest tier counts."""
    best = offers.groupBy("track").agg(F.max_by(F.struct("offer", "tier", "cut"), F.struct(F.col("tier"), F.col("offer"))).alias("o"))
    prior = checked.groupBy("track", "stem").agg(F.lit(True).alias("__before"))
    top = 3
    both = present.join(prior, ["track", "stem"], "left").join(best, "track", "left")
    verdict = (
        F.when(F.col("tier") >= top, "best already").when(F.col("__before"), "checked before").when(F.col("o").isNull(), "not found").when(~F.col("cut").eqNullSafe(F.col("o.cut")), "other cut")
        .when(F.col("o.tier") <= F.col("tier"), "no upgrade").otherwise("upgrade")
    )
    return both.select("track", "stem", verdict.alias("verdict"), F.when(verdict == "upgrade", F.col("o.offer")).alias("offer"))


def soft_partition(rows: DataFrame, sung: Column, confidence: Column, least: float, label: str) -> DataFrame:
    """rows with a column part: 1 for those that are surely sung, 0 for the rest; where fewer than two are, all are 0. Labels given within a part are told
    apart by the pair (part, label)."""
    flagged = rows.withColumn("__sure", F.coalesce(sung & (F.coalesce(confidence, F.lit(1.0)) >= least), F.lit(False)))
    enough = flagged.where("__sure").agg((F.count("*") >= 2).alias("__enough"))
    return flagged.crossJoin(F.broadcast(enough)).withColumn(label, F.when(F.col("__enough") & F.col("__sure"), 1).otherwise(0)).drop("__sure", "__enough")  # one row


def nested_keys(rows: DataFrame, id_col: str, payload: str, pattern: str, depth: int = 6) -> DataFrame:
    """Rows (id, path, value) of the keys inside a JSON text that match the pattern, objects down to `depth` levels, values as text."""
    level = rows.select(id_col, F.lit("").alias("path"), F.from_json(payload, "map<string,string>").alias("m"))
    out = None
    for _ in range(depth):
        each = level.select(id_col, "path", F.explode("m").alias("k", "v")).select(id_col, F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("k")).alias("path"), "k", "v")
        hit = each.where(F.lower("k").rlike(pattern)).select(id_col, "path", F.col("v").alias("value"))
        out = hit if out is None else out.unionByName(hit)
        level = each.where(F.substring(F.trim("v"), 1, 1) == "{").select(id_col, "path", F.from_json("v", "map<string,string>").alias("m"))
    return out
