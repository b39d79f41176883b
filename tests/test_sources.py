from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklattice.sources import cells, collection, files, playlists


def test_cells_tolerate_missing_and_bad_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,n,x\nfoo,12,1.5\n"=SUM(1)",oops,\n,,2\n', encoding="utf-8")
    schema = T.StructType.fromDDL("a string, n int, x double, extra boolean")
    got = [tuple(r) for r in cells.scan(spark, str(tmp_path / "t.csv"), schema).collect()]
    assert got == [("foo", 12, 1.5, False), ("=SUM(1)", 0, 0.0, False), ("", 0, 2.0, False)]
    path = cells.write(spark.createDataFrame([("=1", 1), ("ok", None)], "a string, n int"), str(tmp_path / "out"))
    assert "'=1" in "".join(p.read_text() for p in (tmp_path / "out").rglob("*.csv"))
    assert sorted(tuple(r) for r in cells.scan(spark, path, T.StructType.fromDDL("a string, n int")).collect()) == [("=1", 1), ("ok", 0)]


def test_collection_scan(spark, tmp_path):
    (tmp_path / "c.xml").write_text("""<COLLECTION>
<TRACK TrackID="1" Name="One &amp; Two" Artist="Anna" TotalTime="200" AverageBpm="128.0" Tonality="8A" Location="file://localhost/D:/x%20y.mp3" Size="10"><POSITION_MARK Name="" Type="0" Start="1.5" Num="0"/><POSITION_MARK Name="" Type="4" Start="2" End="4" Num="-1"/></TRACK>
<TRACK TrackID="2" Name="Jingle" TotalTime="12"><POSITION_MARK Name="" Type="0" Start="-1" Num="9"/><POSITION_MARK Name="" Type="0" Start="1" Num="1"/></TRACK>
</COLLECTION>""")
    got = collection.scan(spark, str(tmp_path / "c.xml")).collect()
    assert [(r["ref"], r["title"], r["location"]) for r in got] == [("1", "One & Two", "/D:/x y.mp3")]
    kinds = {r["ref"]: (r["hot"], r["memory"], r["loops"], r["bad"]) for r in collection.mark_kinds(collection.scan(spark, str(tmp_path / "c.xml"), 0)).collect()}
    assert kinds == {"1": (1, 1, 1, 0), "2": (1, 0, 0, 1)}


def test_files_hash_only_what_changed(spark, tmp_path):
    (tmp_path / "outputs").mkdir()
    for name in ("Anna - One.mp3", "b.MP3", "c.txt", "outputs/d.mp3"):
        (tmp_path / name).write_bytes(name.encode())
    first = files.scan(spark, str(tmp_path), ["mp3"])
    assert first.count() == 2
    known = first.withColumn("sha256", F.lit("kept")).cache()
    known.count()
    (tmp_path / "b.MP3").write_bytes(b"changed content")
    again = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.scan(spark, str(tmp_path), ["mp3"], known=known).collect()}
    assert again["Anna%20-%20One.mp3" if "Anna%20-%20One.mp3" in again else "Anna - One.mp3"] == "kept" and len(again["b.MP3"]) == 64
    lib = files.library_entries(spark.createDataFrame([("x/Anna Bee - One Two.mp3",)], "path string")).collect()[0]
    assert lib["all_tokens"] == ["anna", "bee", "one", "two"] and lib["title_tokens"] == ["one", "two"]


def test_playlists(spark, tmp_path):
    (tmp_path / "mine.csv").write_text('﻿Track URI,Track Name,Album Name,Artist Name(s),Release Date,Duration (ms),Added At,Genres,Record Label\nu:1,One,LP,"A;B",2020-01-02,200500,2024-01-01,"x, y",L\nu:2,,,,,,,,\n', encoding="utf-8")
    got = playlists.scan(spark, str(tmp_path / "mine.csv")).collect()
    assert len(got) == 1 and got[0]["artists"] == ["A", "B"] and got[0]["duration_sec"] == 200.5 and got[0]["genres"] == ["x", "y"] and got[0]["playlist"] == "mine.csv" and got[0]["year"] == "2020"
    rows = spark.createDataFrame([("p", 2, 5.0, "B", "/b"), ("p", 1, 3.0, "A", "/a"), ("p", 3, 1.0, None, "/c")], "p string, o int, s double, t string, f string")
    lines = playlists.m3u_lines(rows, "p", "o", F.col("s"), F.col("t"), F.col("f"))
    assert [r["line"] for r in lines.orderBy("place").collect()] == ["#EXTINF:3,A\n/a", "#EXTINF:5,B\n/b"]
    playlists.write(lines, "p", str(tmp_path / "out"))
    files_ = list((tmp_path / "out" / "p=p").glob("*.txt"))
    assert len(files_) == 1 and files_[0].read_text() == "#EXTM3U\n#EXTINF:3,A\n/a\n#EXTINF:5,B\n/b\n"
