import struct
import zlib

import pytest
from pyspark.sql import functions as F

from brookmill.operators import annotate as A
from brookmill.operators.lengths import LengthConfig, series_tokens
from brookmill.sources.media import image_header, probe_paths, read_image_headers


def png(w, h, kind=2):
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def jpeg(w, h, n=3):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x11\x08" + struct.pack(">HHB", h, w, n) + b"\x00" * 20


def test_headers(spark, tmp_path):
    assert image_header(png(7, 9)) == (7, 9, 3, "RGB") and image_header(png(1, 2, 6)) == (1, 2, 4, "RGBA") and image_header(jpeg(640, 480)) == (640, 480, 3, "RGB") and image_header(jpeg(5, 6, 1)) == (5, 6, 1, "L")
    assert image_header(b"GIF89a" + struct.pack("<HH", 3, 4) + b"xx") == (3, 4, 1, "P")
    (tmp_path / "a.png").write_bytes(png(7, 9))
    (tmp_path / "b.png").write_bytes(b"x")
    got = {r["path"][-5:]: r for r in read_image_headers(spark, str(tmp_path)).collect()}
    assert got["a.png"]["width"] == 7 and got["b.png"]["width"] is None and "no image header" in got["b.png"]["error"]


def test_probes_fail_alone(spark):
    def probe(path):
        if path == "bad":
            raise OSError("gone")
        return 4, 3, 2.5, 10, 4.0

    got = {r["path"]: r for r in probe_paths(spark.createDataFrame([("a",), ("bad",), (None,), ("a",)], "path string"), probe).collect()}
    assert set(got) == {"a", "bad"} and got["a"]["nb_frames"] == 10 and got["bad"]["error"] == "OSError: gone" and got["bad"]["width"] is None


META = "struct<width:int,height:int,source_fps:double,nb_frames:int,duration:double>"


def test_annotations(spark):
    rows = [("v", (4, 3, 2.0, 8, 4.0), ["a"], [(1, 1)], "s", [3, 2], "prediction", "t"), ("v", (4, None, 2.0, 8, 4.0), ["a", "b"], [(1, 1)], None, None, "classification", None), (None, None, None, None, "", [1], None, None)]
    df = spark.createDataFrame(rows, f"v string, m {META}, i array<string>, im array<struct<w:int,h:int>>, s string, sh array<int>, task string, target string")
    c = [F.col(x) for x in ("v", "m", "i", "im", "s", "sh", "task", "target")]
    out = df.select(A.todo(c[1], c[4], c[5]).alias("t"), A.usable_meta(*c[:4], c[5]).alias("u"), A.why_not(c[6], c[4], c[7]).alias("w")).collect()
    assert [tuple(r["t"]) for r in out] == [(False, False), (False, False), (True, False)]
    assert [tuple(r["u"]) for r in out] == [(True, True, True), (False, False, False), (False, False, False)] and [r["w"] for r in out] == [None, "task", "task"]
    x = A.coverage(df.withColumnsRenamed({"m": "video_meta", "sh": "ts_shape"}), []).first()
    assert (x["n"], x["n_video_meta"], x["n_ts_shape"]) == (3, 2, 2)


def test_requests(spark):
    m = F.struct(F.lit(60.0).alias("duration"), F.lit(600).alias("nb_frames"), F.lit(10.0).alias("source_fps"))
    one = spark.range(1)
    assert [one.select(A.request_frames(m, F.lit(k)).alias("x")).first()["x"] for k in (0, 10, 49, 80)] == [50, 40, 4, 4]
    assert tuple(one.select(A.capped_size(F.lit(1000), F.lit(500), 5000).alias("x")).first()["x"]) == (100, 50) and tuple(one.select(A.capped_size(F.lit(10), F.lit(5), 5000).alias("x")).first()["x"]) == (10, 5)
    parts = one.select(A.request_parts(A.square_tags(F.lit("<video>x</video>")), F.array(F.lit("a"), F.lit("b")), F.lit(2), 3).alias("x")).first()["x"]
    assert [tuple(p) for p in parts] == [("text", "[video]x[/video]"), ("frame", "0"), ("frame", "1"), ("image", "a")]


def test_length_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, [32, 2]), (2, [17, 1]), (3, None)], "id int, shape array<int>")
    key = A.length_key(LengthConfig(), F.col("shape"))
    first = A.with_cached_lengths(rows, key, series_tokens(F.col("shape")), None)
    A.save_lengths(first, str(tmp_path / "c"))
    again = A.with_cached_lengths(rows, key, F.lit(-1).cast("bigint"), A.load_lengths(spark, str(tmp_path / "c")))
    assert {(r["id"], r["length"]) for r in again.collect()} == {(1, 4), (2, 2), (3, 0)}
    other = A.with_cached_lengths(rows, A.length_key(LengthConfig(series_patch=8), F.col("shape")), F.lit(-1).cast("bigint"), A.load_lengths(spark, str(tmp_path / "c")))
    assert {r["length"] for r in other.collect()} == {-1}
    A.assert_same_rows(rows, first, "id")
    with pytest.raises(ValueError):
        A.assert_same_rows(rows, first.where("id < 3"), "id")
