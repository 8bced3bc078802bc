"""Width, height and defects of images, from the bytes of their headers: columns over binary content, without decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first bytes of each format, in hex, and where whole files end.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8", "gif": "47494638", "bmp": "424D", "tiff-le": "49492A00", "tiff-be": "4D4D002A", "webp": "52494646"}
PNG_END, JPEG_END, GIF_END = "49454E44AE426082", "FFD9", "3B"
WEBP_NAME, WEBP_LOSSY, WEBP_LOSSLESS, WEBP_EXTENDED = "57454250", "56503820", "5650384C", "56503858"
TIFF_WIDTH, TIFF_HEIGHT, TIFF_SHORT = 256, 257, 3
#: A JPEG's frame header comes after others; so many of them are passed.
SEGMENTS = 4096
#: Bytes from a JPEG's start, and from a TIFF's first directory, that a size is read from; bytes that tell an end.
JPEG_REACH, TIFF_REACH, TAIL = SEGMENTS * 65_537 + 16, 2 + 12 * 65_535, 8


def _hex(c: Column, at, n: int) -> Column:
    """n bytes from place at (from 0); fewer at the end."""
    at = at if isinstance(at, Column) else F.lit(at)
    return F.hex(F.substring(c, at.cast("int") + 1, F.lit(n)))


def _number(digits: Column) -> Column:
    return F.conv(F.nullif(digits, F.lit("")), 16, 10).cast("long")


def big(c: Column, at, n: int) -> Column:
    """A whole number of n bytes, most significant first; null where the content ends before."""
    h = _hex(c, at, n)
    return F.when(F.length(h) == 2 * n, _number(h))


def little(c: Column, at, n: int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    h = F.concat(*[_hex(c, at + k, 1) for k in reversed(range(n))])
    return F.when(F.length(h) == 2 * n, _number(h))


def _size(w: Column, h: Column) -> Column:
    return F.struct(w.alias("width"), h.alias("height"))


def _jpeg(c: Column) -> Column:
    """Walks the segments to the frame header; markers without a length and fill bytes are passed."""

    def step(s, _):
        p = s["p"]
        kind = big(c, p + 1, 1)
        frame = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        bare = (kind == 0x01) | kind.between(0xD0, 0xD8)
        stop = big(c, p, 1).isNull() | (big(c, p, 1) != 0xFF) | kind.isNull() | kind.isin(0xD9, 0xDA)
        onward = F.when(kind == 0xFF, p + 1).when(bare, p + 2).otherwise(p + 2 + big(c, p + 2, 2))
        size = lambda at: F.when(frame, big(c, p + at, 2))
        end = F.coalesce(stop, F.lit(True)) | F.coalesce(frame, F.lit(False))
        moved = F.struct(F.coalesce(F.when(end, F.lit(-1)).otherwise(onward), F.lit(-1)).cast("long").alias("p"), size(7).alias("w"), size(5).alias("h"))
        return F.when(p < 0, s).otherwise(moved)

    none = F.lit(None).cast("long")
    start = F.struct(F.lit(2).cast("long").alias("p"), none.alias("w"), none.alias("h"))
    steps = F.sequence(F.lit(1), F.least(F.lit(SEGMENTS), F.floor(F.length(c) / 2) + 1).cast("int"))
    return F.aggregate(steps, start, step, lambda s: _size(s["w"], s["h"]))


def _tiff(c: Column, number) -> Column:
    """Width and height among the entries of the first directory."""
    first = number(c, 4, 4)
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(number(c, first, 2), F.lit(0)) - 1), lambda k: first + 2 + 12 * k)
    entries = F.transform(F.when(F.coalesce(number(c, first, 2), F.lit(0)) > 0, places).otherwise(F.array().cast("array<bigint>")), lambda p: F.struct(number(c, p, 2).alias("tag"), F.when(number(c, p + 2, 2) == TIFF_SHORT, number(c, p + 8, 2)).otherwise(number(c, p + 8, 4)).alias("v")))
    of = lambda tag: F.get(F.filter(entries, lambda e: e["tag"] == tag), F.lit(0))["v"]
    return _size(of(TIFF_WIDTH), of(TIFF_HEIGHT))


def _webp(c: Column) -> Column:
    kind, packed = _hex(c, 12, 4), little(c, 21, 4)
    low = lambda x: x.bitwiseAND(0x3FFF)
    lossy = _size(low(little(c, 26, 2)), low(little(c, 28, 2)))
    lossless = _size(low(packed) + 1, low(F.shiftright(packed, 14)) + 1)
    extended = _size(little(c, 24, 3) + 1, little(c, 27, 3) + 1)
    return F.when(kind == WEBP_LOSSY, lossy).when(kind == WEBP_LOSSLESS, lossless).when(kind == WEBP_EXTENDED, extended)


def header(c: Column, size: Column | None = None, end: Column | None = None) -> Column:
    """struct(format, width, height, error) of image bytes: PNG, JPEG, GIF, BMP, TIFF, WebP.

    c may have the header only, if the file's size and its last TAIL bytes are given as size and end.

    The error says what is wrong: no content, no known format, a header that ends early or says no size, or a file that
    ends before its format's end; in the last case the size is known nevertheless.
    """
    n = F.length(c) if size is None else size
    end, last = (c, n) if end is None else (end, F.length(end))
    is_ = {k: _hex(c, 0, len(m) // 2) == m for k, m in MAGIC.items()}
    webp = is_["webp"] & (_hex(c, 8, 4) == WEBP_NAME)
    found = (
        F.when(is_["png"], _size(big(c, 16, 4), big(c, 20, 4)))
        .when(is_["jpeg"], _jpeg(c))
        .when(is_["gif"], _size(little(c, 6, 2), little(c, 8, 2)))
        .when(is_["bmp"], _size(little(c, 18, 4), F.least(little(c, 22, 4), 2**32 - little(c, 22, 4))))  # rows from the top have a negative height
        .when(is_["tiff-le"], _tiff(c, little))
        .when(is_["tiff-be"], _tiff(c, big))
        .when(webp, _webp(c))
    )
    kind = F.when(webp, "webp")
    for k in ("tiff-be", "tiff-le", "bmp", "gif", "jpeg", "png"):
        kind = F.when(is_[k], k.split("-")[0]).otherwise(kind)
    tail = lambda h: _hex(end, F.greatest(last - len(h) // 2, F.lit(0)), len(h) // 2) == h
    whole = (
        F.when(kind == "png", tail(PNG_END)).when(kind == "jpeg", tail(JPEG_END)).when(kind == "gif", tail(GIF_END))
        .when(kind == "bmp", little(c, 2, 4) <= n).when(kind == "webp", little(c, 4, 4) + 8 <= n).otherwise(F.lit(True))
    )

    def said(s):
        known = (s["width"] > 0) & (s["height"] > 0)
        return F.struct(
            kind.alias("format"), F.when(known, s["width"]).cast("int").alias("width"), F.when(known, s["height"]).cast("int").alias("height"),
            F.when(F.coalesce(n, F.lit(0)) == 0, "empty file").when(kind.isNull(), "no image of a known format")
            .when(s["width"].isNull() | s["height"].isNull(), F.concat(kind, F.lit(": header is cut off or damaged"))).when(~known, F.concat(kind, F.lit(": no size")))
            .when(~F.coalesce(whole, F.lit(False)), F.concat(kind, F.lit(": file is cut off"))).alias("error"),
        )

    return F.get(F.transform(F.array(found), said), F.lit(0))  # a one-element array names the size
