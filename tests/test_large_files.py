"""Files that are hashed by ranges against hashes of the whole."""

import hashlib
import random
import struct

from corpusops.sources import io


def test_files_over_the_limit_are_hashed_in_steps(spark, tmp_path):
    noise = random.Random(5).randbytes
    directory = struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 700, 0) + struct.pack(">HHII", 257, 4, 1, 900)
    far = noise(180_000)
    files = {
        "a b.bin": noise(300_000),
        "feed.bin": noise(90_000) + b"\n",
        "feeds.bin": b"\n" * 70_000,
        "mark.bin": b"\xef\xbb\xbf" + noise(120_000),
        "mark.txt": b"\xef\xbb\xbf" + b"x\r\n" * 40_000,
        "stretch.bin": b"\0" * 150_000,
        "packed.gz": noise(80_000),
        "far.tif": b"MM\0*" + struct.pack(">I", 180_008) + far + directory + noise(40_000),
        "whole.jpg": b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 60_000) + noise(59_998) + b"\xff\xc0\0\x0b\x08\0\x07\0\x09\x01\x01\x11\0" + noise(30_000) + b"\xff\xd9",
        "cut.png": b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 5, 6) + noise(100_000),
        "small.bin": noise(900),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = {r["name"]: tuple(r[2:]) for r in io.read_binary(spark, str(tmp_path), whole=50_000).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {n: (r[0], r[1]) for n, r in rows.items()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in files.items()}
    assert rows == {r["name"]: tuple(r[2:]) for r in io.read_binary(spark, str(tmp_path)).collect()}
    assert rows["far.tif"][2:] == ("tiff", 700, 900, None) and rows["whole.jpg"][2:] == ("jpeg", 9, 7, None) and rows["cut.png"][2:] == ("png", 5, 6, "png: file is cut off")
