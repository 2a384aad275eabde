import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import paths as P
from cairn.functions.codecs import blake3, compress_frame, decompress_frame

# fixed values: published digests of the bytes i mod 251
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    3: "e1be4d7a8ab5560aa4199eea339849ba8e293d55ca0a81006726d184519e647f",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_blake3_vectors_together_and_alone():
    data = [bytes(i % 251 for i in range(n)) for n in VECTORS]
    assert blake3(data) == list(VECTORS.values())
    assert [blake3([d])[0] for d in data] == list(VECTORS.values())


def test_blake3_agrees_with_the_class_on_sparks_path(spark):
    jvm = spark._jvm.org.apache.commons.codec.digest.Blake3
    for n in (1023, 1024, 1025, 2048, 3000, 5121, 7 * 1024):
        data = bytes(i * 7 % 256 for i in range(n))
        assert blake3([data])[0] == bytes(b & 255 for b in jvm.hash(data)).hex()


def test_zstd_frames_are_checked():
    frame = compress_frame(b"abc" * 100)
    assert decompress_frame(frame, 300, 1000) == b"abc" * 100
    for bad in (lambda: decompress_frame(frame, 299, 1000), lambda: decompress_frame(frame, 300, 299), lambda: decompress_frame(frame + frame, 300, 1000), lambda: decompress_frame(frame[:-2], 300, 1000)):
        with pytest.raises(Exception):  # noqa: B017
            bad()


@pytest.mark.parametrize(
    ("rule", "path", "is_dir", "hit"),
    [
        ("*.tmp", "a/b.tmp", False, True), ("*.tmp", "a/b.tmp/c", False, False), ("build/", "x/build", True, True), ("build/", "x/build", False, False),
        ("a/*.c", "a/x.c", False, True), ("a/*.c", "a/b/x.c", False, False), ("?.txt", "é.txt", False, True), ("?.txt", "ab.txt", False, False),
        ("/a", "a", False, False), ("**", "abc", False, True), ("!x", "!x", False, True), ("[a]", "[a]", False, True), ("[a]", "a", False, False), ("a\\b", "a/b", False, True),
    ],
)
def test_ignore_rules(spark, rule, path, is_dir, hit):
    from cairn.sources.tree import Rules

    assert Rules([rule]).match(path, is_dir) is hit
    row = spark.range(1).select(P.ignored([rule], F.lit(path), F.lit(is_dir)).alias("x")).first()
    assert row.x is hit


def test_paths(spark):
    rows = spark.createDataFrame([("",), ("a",), ("a/b",), ("a/b\nc/d",)], "p string").select("p", P.parent_path("p").alias("up"), P.entry_name("p").alias("name"), P.path_depth("p").alias("depth"), P.ancestors("p").alias("above")).collect()
    assert [(r.up, r.name, r.depth, r.above) for r in rows] == [("", "", 0, []), ("", "a", 1, []), ("a", "b", 2, ["a"]), ("a/b\nc", "d", 3, ["a", "a/b\nc"])]
    t = spark.createDataFrame([(-1,), (1_700_000_000_123_456_789,)], "ns long").select(*P.floor_seconds("ns")).collect()
    assert [tuple(r) for r in t] == [(-1, 999_999_999), (1_700_000_000, 123_456_789)]
    assert re.fullmatch(P.HASH_PATTERN.replace(r"\z", ""), "a" * 64)
