"""Headers and tags of files made here, byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from tracklattice.sources import audio


def frame(name, said, code=3, comment=False):
    body = bytes([code]) + (b"eng\0" if comment else b"") + said.encode({0: "latin-1", 1: "utf-16", 3: "utf-8"}[code])
    return name + struct.pack(">I", len(body)) + b"\0\0" + body


def tag(*frames):
    body = b"".join(frames) + b"\0" * 20
    return b"ID3\x03\0\0" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body


def wav(seconds=2, rate=8000, channels=2, tags=b""):
    data = b"\0" * (seconds * rate * channels * 2)
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + (b"id3 " + struct.pack("<I", len(tags)) + tags + b"\0" * (len(tags) % 2) if tags else b"") + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def aiff(frames=44100 * 3, rate=44100):
    comm = struct.pack(">HIH", 1, frames, 16) + struct.pack(">HQ", 16383 + 15, rate << (63 - 15))
    body = b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm
    return b"FORM" + struct.pack(">I", len(body)) + body


def flac(rate=48000, frames=96000):
    info = b"\0" * 10 + (rate << 44 | 1 << 41 | 15 << 36 | frames).to_bytes(8, "big") + b"\0" * 16
    notes = ["TITLE=One", "InitialKey=8A", "BPM=128.0", "other=x"]
    body = struct.pack("<I", 1) + b"v" + struct.pack("<I", len(notes)) + b"".join(struct.pack("<I", len(n)) + n.encode() for n in notes)
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(body).to_bytes(3, "big") + body


def test_headers():
    assert audio.header(wav())[:4] == (2.0, 8000, 2, 256000)
    assert audio.header(aiff())[:4] == (3.0, 44100, 1, 705600)
    seconds, rate, channels, bits, tags = audio.header(flac())
    assert (seconds, rate, channels) == (2.0, 48000, 2) and bits > 0 and tags == {"title": "One", "key_raw": "8A", "bpm": "128.0"}
    assert audio.header(tag(frame(b"TIT2", "Zwölf", 1), frame(b"TPE1", "Ann", 0), frame(b"COMM", "9A|E3|HYPN|INST", 3, True)))[4] == {"title": "Zwölf", "artist": "Ann", "comment": "9A|E3|HYPN|INST"}


@pytest.mark.parametrize("raw", [b"", b"RIFF", b"RIFF\0\0\0\0WAVEfmt \x10", flac()[:30], aiff()[:25], b"ID3\x03\0\0\0\0\x7f\x7fTIT2\xff\xff\xff\xff\0\0", b"text", wav()[:60]])
def test_broken_files_are_read_as_far_as_they_go(raw):
    assert len(audio.header(raw)) == 5


def test_scan_and_tagged_library(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.wav").write_bytes(wav(tags=tag(frame(b"TKEY", "Am"), frame(b"TBPM", "127.5"), frame(b"COMM", "9A|E3|HYPN|INST|G007", 3, True))))
    (tmp_path / "two.mp3").write_bytes(tag(frame(b"TBPM", "999"), frame(b"COMM", "hello", 3, True)))
    (tmp_path / "three.txt").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in audio.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"one.wav", "two.mp3"}
    assert (got["one.wav"]["key"], got["one.wav"]["hint"], got["one.wav"]["duration"]) == ("8A", 127.5, 2.0) and got["two.mp3"]["hint"] is None and got["two.mp3"]["duration"] is None
    lib = audio.tagged(audio.scan(spark, str(tmp_path))).collect()
    assert [(r["key"], r["energy"], r["mood"], r["vocal"], r["grp"]) for r in lib] == [("9A", "3", "HYPN", "INST", "G007")]
    empty = spark.createDataFrame([("x", None)], "path string, content binary")
    assert audio.headers(empty).where(F.col("duration").isNull()).count() == 1
