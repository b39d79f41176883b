"""Headers and tags of audio files, read from their contents in Arrow batches: no file is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklattice.functions import codes
from tracklattice.functions.music import camelot

# fixed values: frames of tags and comment names by field, limits of a tempo that a file may state
FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TBPM": "bpm", "TKEY": "key_raw", "TSRC": "isrc", "COMM": "comment"}
COMMENTS = {"title": "title", "artist": "artist", "album": "album", "genre": "genre", "bpm": "bpm", "tempo": "bpm", "key": "key_raw", "initialkey": "key_raw", "isrc": "isrc", "comment": "comment", "description": "comment"}
LEAST_TEMPO, MOST_TEMPO = 60.0, 200.0
FIELDS = ["title", "artist", "album", "genre", "bpm", "key_raw", "comment", "isrc"]
SCHEMA = "path string, duration double, rate int, channels int, bitrate int, tags map<string,string>"
_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _text(raw: bytes, comment: bool = False) -> str:
    """Text of a frame; a comment has a language and a description before it."""
    if not raw:
        return ""
    code = _ENCODINGS.get(raw[0], "latin-1")
    said = raw[4:] if comment else raw[1:]
    if comment:
        wide = code.startswith("utf-16")
        end = next((i for i in range(0, len(said) - wide, 1 + wide) if said[i : i + 1 + wide] == b"\0" * (1 + wide)), None)
        said = said if end is None else said[end + 1 + wide :]
    return said.decode(code, "replace").split("\0")[0].strip("﻿ ")


def id3(raw: bytes) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag at the beginning of raw; {} where there is none."""
    if len(raw) < 10 or raw[:3] != b"ID3" or raw[3] not in (3, 4):
        return {}
    seven = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = 10 + seven(raw[6:10]), 10, {}
    while at + 10 <= min(end, len(raw)):
        name, size = raw[at : at + 4].decode("latin-1"), seven(raw[at + 4 : at + 8]) if raw[3] == 4 else struct.unpack(">I", raw[at + 4 : at + 8])[0]
        if not name.strip("\0") or size <= 0:
            break
        if name in FRAMES:
            out.setdefault(FRAMES[name], _text(raw[at + 10 : at + 10 + size], name == "COMM"))
        at += 10 + size
    return out


def _chunks(raw: bytes, at: int, order: str) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= len(raw):
        size = struct.unpack(order + "I", raw[at + 4 : at + 8])[0]
        yield raw[at : at + 4], raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def _extended(b: bytes) -> float:
    """An 80-bit float, the form of a rate in AIFF."""
    exponent, mantissa = struct.unpack(">HQ", b[:10])
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def _vorbis(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    at = 4 + struct.unpack("<I", raw[:4])[0]
    for _ in range(struct.unpack("<I", raw[at : at + 4])[0]):
        size = struct.unpack("<I", raw[at + 4 : at + 8])[0]
        name, _, value = raw[at + 8 : at + 8 + size].decode("utf-8", "replace").partition("=")
        if name.lower() in COMMENTS:
            out.setdefault(COMMENTS[name.lower()], value.strip())
        at += 4 + size
    return out


def header(raw: bytes) -> tuple[float | None, int | None, int | None, int | None, dict[str, str]]:
    """(seconds, rate, channels, bits a second, tags) of a WAV, AIFF, FLAC or MP3 file; what cannot be read is null."""
    tags: dict[str, str] = {}
    seconds = rate = channels = bits = None
    try:
        if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
            per_second = 0
            for name, body in _chunks(raw, 12, "<"):
                if name == b"fmt ":
                    channels, rate, per_second = struct.unpack("<HII", body[2:12])
                elif name == b"data" and per_second:
                    seconds, bits = len(body) / per_second, per_second * 8
                elif name in (b"id3 ", b"ID3 "):
                    tags = id3(body)
        elif raw[:4] == b"FORM" and raw[8:12] in (b"AIFF", b"AIFC"):
            for name, body in _chunks(raw, 12, ">"):
                if name == b"COMM":
                    channels, frames, depth = struct.unpack(">HIH", body[:8])
                    rate = int(_extended(body[8:18]))
                    seconds, bits = frames / rate, rate * channels * depth
                elif name == b"ID3 ":
                    tags = id3(body)
        elif raw[:4] == b"fLaC":
            at, last = 4, False
            while not last and at + 4 <= len(raw):
                kind, size = raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
                last, body = raw[at] > 127, raw[at + 4 : at + 4 + size]
                if kind == 0:
                    packed = int.from_bytes(body[10:18], "big")
                    rate, channels, frames = packed >> 44, (packed >> 41 & 7) + 1, packed & (1 << 36) - 1
                    seconds = frames / rate if rate else None
                    bits = int(len(raw) * 8 / seconds) if seconds else None
                elif kind == 4:
                    tags = _vorbis(body)
                at += 4 + size
        else:
            tags = id3(raw)
    except (struct.error, IndexError, ZeroDivisionError, OverflowError):  # a broken file keeps what was read of it
        pass
    return seconds, rate, channels, bits, {k: v for k, v in tags.items() if v}


def headers(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Rows (path, duration, rate, channels, bitrate, tags) of files whose contents stand in a binary column. Empty and unreadable files give nulls and no tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(p, *header(bytes(c) if c is not None else b"")) for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "duration", "rate", "channels", "bitrate", "tags"]).astype(
                {"duration": "Float64", "rate": "Int32", "channels": "Int32", "bitrate": "Int32"}
            )

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, SCHEMA)


def scan(spark: SparkSession, root: str, pattern: str = "*.{mp3,MP3,wav,WAV,aif,aiff,AIF,AIFF,flac,FLAC}") -> DataFrame:
    """Headers and tags of the audio files under root, one row each, tags as columns; key is the stated key in wheel notation, hint the stated tempo within its limits."""
    got = headers(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root))
    fields = [F.coalesce(F.col("tags")[f], F.lit("")).alias(f) for f in FIELDS]
    bpm = F.col("tags")["bpm"].try_cast("double")
    return got.select("path", "duration", "rate", "channels", "bitrate", *fields, camelot(F.col("tags")["key_raw"]).alias("key"), F.when((bpm > LEAST_TEMPO) & (bpm < MOST_TEMPO), bpm).alias("hint"))


def tagged(rows: DataFrame, comment: str = "comment") -> DataFrame:
    """rows whose comment holds a line of functions.codes, with its fields in place of the comment."""
    read = rows.withColumn("__line", codes.tag_fields(F.col(comment))).where("__line is not null").drop(comment)
    kept = [c for c in read.columns if c not in ("__line", "key", "energy", "mood", "vocal", "category", "grp")]
    return read.select(*kept, "__line.*")
