"""From labelled boxes to text: lines, reading order, decoding. One row per image; images are read in Arrow batches.

The greedy rule goes token by token over one image, but over all images of a batch at once: step t takes the token t of
each. Lists of ends have one column a group, in blocks of images of similar numbers of tokens. Comparisons are Spark's: nulls
are passed over by least and greatest and come first in order, NaN is the largest value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T

LINES = "array<struct<box:struct<x1:double,y1:double,x2:double,y2:double>,members:array<struct<cy:double,cx:double,idx:bigint,ch:string,x1:double,y1:double,x2:double,y2:double>>>>"
#: Ends held at once in a block of images: images times groups. One image of more tokens is a block of its own.
CELLS = 1 << 18


def tokens_of(df: DataFrame) -> DataFrame:
    """(uid, tokens) sorted by centre, from rows (uid, idx, ch, x1, y1, x2, y2)."""
    t = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("cy"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.col("idx").cast("long").alias("idx"), "ch", "x1", "y1", "x2", "y2")
    return df.groupBy("uid").agg(F.sort_array(F.collect_list(t)).alias("tokens"))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles and where they are null."""
    column = column.cast(pa.float64())
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _either(pick, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """pick of two values, the other one where one is null."""
    (a, no_a), (b, no_b) = a, b
    out = pick(a, b)
    if no_a.any() or no_b.any():
        out = np.where(no_a, b, np.where(no_b, a, out))
    return out, no_a & no_b


#: NaN is the largest value
LEAST, GREATEST = np.fmin, np.maximum


def _joined(low: tuple, high: tuple, starts: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The group of each token, from 0, in the order in which groups open: a token joins the first group of its image
    whose ends overlap its own enough, or opens a new one. Ends and their nulls are of all tokens, image after image."""
    at = np.zeros(len(low[0]), np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    while len(by_size) and sizes[by_size[0]]:
        widest = int(sizes[by_size[0]])
        block, by_size = np.split(by_size, [max(1, CELLS // widest)])
        start, size = starts[block], sizes[block]
        a, b = ((np.zeros((len(block), widest)), np.ones((len(block), widest), bool)) for _ in range(2))
        opened = np.zeros(len(block), np.int64)
        for t in range(widest):
            m = int(np.searchsorted(-size, -t))  # sizes fall: the first m images have a token t
            rows, token, g = np.arange(m), start[:m] + t, int(opened.max(initial=0))
            own = [(v[token, None], no[token, None]) for v, no in (low, high)]
            ends = [(v[:m, :g], no[:m, :g]) for v, no in (a, b)]
            (top, no_top), (bottom, no_bottom) = _either(GREATEST, ends[1], own[1]), _either(LEAST, ends[0], own[0])
            (inner, no_inner), (outer, no_outer) = _either(LEAST, ends[1], own[1]), _either(GREATEST, ends[0], own[0])
            with np.errstate(all="ignore"):
                union, shared = top - bottom, np.where(no_inner | no_outer, 0.0, GREATEST(inner - outer, 0.0))
                share = np.where(~(union <= 0) & ~(no_top | no_bottom), shared / union, 0.0)
            hit = ~(share < threshold) & (np.arange(g) < opened[:m, None])
            k = np.where(hit.any(1), hit.argmax(1), opened[:m]) if g else opened[:m].copy()
            opened[:m] = np.maximum(opened[:m], k + 1)
            at[token] = k
            for (v, no), (x, no_x), pick in ((a, low, LEAST), (b, high, GREATEST)):
                v[rows, k], no[rows, k] = _either(pick, (v[rows, k], no[rows, k]), (x[token], no_x[token]))
    return at


def _extent(pick, values: tuple, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least or greatest value of each line, and where it has none."""
    known = ~values[1]
    out = np.full(n, np.nan if pick is LEAST else -np.inf)
    pick.at(out, line[known], values[0][known])
    return out, np.bincount(line[known], minlength=n) == 0


def _order(*keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Order by keys (value, null), the first one first; nulls come first, NaN last."""
    return np.lexsort([k for value, no in reversed(keys) for k in ((np.where(no, 0, value), ~no) if no.any() else (value,))])


def _read(tokens: pa.Array, threshold: float, rtl: bool) -> dict:
    """A batch of images in reading order: read (places of tokens), line (numbered from 0 within the image) and new (it
    begins a line that is not the image's first) of each token read; of each image vertical, its number of lines and its
    offset; at: each token's group in order of opening."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat, starts, n = tokens.flatten(), offsets[:-1], len(sizes)
    v = {c: _numbers(flat.field(c)) for c in ("cy", "cx", "x1", "y1", "x2", "y2")}
    image = np.repeat(np.arange(n), sizes)
    none = np.zeros(len(image), bool)
    found = {}
    for axis in "xy":
        at = _joined(v[f"{axis}1"], v[f"{axis}2"], starts, sizes, threshold)
        groups = np.zeros(n, np.int64)
        np.maximum.at(groups, image, at + 1)
        line = (np.cumsum(groups) - groups)[image] + at
        lone = np.bincount(np.repeat(np.arange(n), groups)[np.bincount(line, minlength=int(groups.sum())) == 1], minlength=n)
        with np.errstate(all="ignore"):
            found[axis] = at, groups, lone / groups - 0.01 * sizes / groups
    # fewer groups first, then fewer lone tokens and more tokens a group; ties go to columns
    (at_v, n_v, f_v), (at_h, n_h, f_h) = found["x"], found["y"]
    vertical = (n_v < n_h) | (n_v == n_h) & ~(f_v > f_h)
    at, groups = np.where(vertical[image], at_v, at_h), np.where(vertical, n_v, n_h)
    line, total = (np.cumsum(groups) - groups)[image] + at, int(groups.sum())
    columns, side = np.repeat(vertical, groups), -1 if rtl else 1
    with np.errstate(all="ignore"):
        centre = {}
        for axis in "xy":
            (low, no_low), (high, no_high) = _extent(LEAST, v[f"{axis}1"], line, total), _extent(GREATEST, v[f"{axis}2"], line, total)
            centre[axis] = (low + high) / 2, no_low | no_high
    x, y = (side * centre["x"][0], centre["x"][1]), centre["y"]
    swap = lambda p, a, b: tuple(np.where(p, s, t) for s, t in zip(a, b))
    known = lambda value: (value, np.zeros(len(value), bool))
    ordered = _order(known(np.repeat(np.arange(n), groups)), swap(columns, x, y), swap(columns, y, x), known(np.arange(total)))
    place = np.empty(total, np.int64)
    place[ordered] = np.arange(total)
    name = flat.field("ch").dictionary_encode()
    rank = pc.rank(name.dictionary, sort_keys="ascending").to_numpy(zero_copy_only=False).astype(np.int64)
    code = name.indices.fill_null(0).to_numpy(zero_copy_only=False)
    named = (rank[code] if len(rank) else np.zeros(len(code), np.int64)), name.indices.is_null().to_numpy(zero_copy_only=False)
    idx = flat.field("idx").fill_null(0).to_numpy(zero_copy_only=False), flat.field("idx").is_null().to_numpy(zero_copy_only=False)
    read = _order(known(place[line]), swap(vertical[image], v["cy"], (side * v["cx"][0], v["cx"][1])), idx, named)
    number = (place[line] - (np.cumsum(groups) - groups)[image])[read]
    new = np.concatenate([none[:1], number[1:] != number[:-1]]) & (number > 0)
    return {"flat": flat, "offsets": pa.array(offsets, pa.int32()), "at": at, "read": read, "line": number, "new": new, "vertical": vertical, "n": groups}


def _reader(threshold: float, rtl: bool):
    """tokens -> struct: the choice of rows or columns, the group of each token from 1, and idx in reading order."""

    def read(tokens: pa.Array) -> pa.Array:
        r = _read(tokens, threshold, rtl)
        lists = (pa.ListArray.from_arrays(r["offsets"], x) for x in (pa.array(r["at"] + 1, pa.int32()), r["flat"].field("idx").take(pa.array(r["read"]))))
        return pa.StructArray.from_arrays([pa.array(r["vertical"]), pa.array(r["n"], pa.int32()), *lists], ["vertical", "n_lines", "at", "read"])

    return F.arrow_udf(read, "vertical boolean, n_lines int, at array<int>, read array<bigint>")


def _writer(threshold: float, rtl: bool):
    """tokens -> struct: number of lines, and their text with a blank between lines."""

    def write(tokens: pa.Array) -> pa.Array:
        r = _read(tokens, threshold, rtl)
        ch = r["flat"].field("ch").take(pa.array(r["read"]))
        ch = pc.if_else(pc.equal(ch, "?"), T.UNKNOWN, ch).fill_null("")
        ch = pc.if_else(pa.array(r["new"]), pc.binary_join_element_wise(" ", ch, ""), ch)
        text = pc.binary_join(pa.ListArray.from_arrays(r["offsets"], ch), "")
        return pa.StructArray.from_arrays([pa.array(r["n"], pa.int32()), text], ["n_lines", "text"])

    return F.arrow_udf(write, "n_lines int, text string")


def reading(rows: DataFrame, threshold: float = 0.35, rtl: bool = True) -> DataFrame:
    """(uid, vertical, n_lines, read): rows of text or columns, whichever groups better, and idx in reading order."""
    return rows.select("uid", _reader(threshold, rtl)("tokens").alias("r")).select("uid", "r.vertical", "r.n_lines", "r.read")


def auto_lines(rows: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(uid, vertical, lines): rows of text or columns, whichever groups better; ties go to columns."""
    found = rows.select("uid", "tokens", _reader(threshold, True)("tokens").alias("r")).select("uid", "tokens", "r.vertical", "r.n_lines", "r.at")

    def group(m):
        side = lambda f, c: f(F.transform(m, lambda t: t[c]))
        return F.struct(B.box(side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2")).alias("box"), m.alias("members"))

    own = F.when(F.col("n_lines") > 0, F.sequence(F.lit(1), F.col("n_lines"))).otherwise(F.array().cast("array<int>"))
    lines = F.transform(F.transform(own, lambda g: F.filter("tokens", lambda t, i: F.get("at", i) == g)), group)
    return found.select("uid", "vertical", lines.cast(LINES).alias("lines"))


def order_lines(lines: Column, vertical: Column, rtl: bool = True) -> Column:
    """Lines in reading order, and the tokens of each: by x (from the right if rtl) or, in columns, by y."""
    centre = lambda g, a: (g["box"][f"{a}1"] + g["box"][f"{a}2"]) / 2
    side = -1 if rtl else 1
    key = lambda g: F.when(vertical, F.struct((side * centre(g, "x")).alias("a"), centre(g, "y").alias("b"))).otherwise(F.struct(centre(g, "y").alias("a"), (side * centre(g, "x")).alias("b")))
    tokens = lambda g: F.transform(F.sort_array(F.transform(g["members"], lambda t: F.struct(F.when(vertical, t["cy"]).otherwise(side * t["cx"]).alias("k"), t["idx"].alias("idx"), t["ch"].alias("ch")))), lambda t: F.struct(t["idx"].alias("idx"), t["ch"].alias("ch")))
    keyed = F.sort_array(F.transform(lines, lambda g, i: F.struct(key(g).alias("k"), i.alias("i"), tokens(g).alias("t"))))
    return F.transform(keyed, lambda g: g["t"])


def decode(df: DataFrame, threshold: float = 0.35, rtl: bool = True) -> DataFrame:
    """(uid, n_lines, pred_text) from rows (uid, idx, ch, x1, y1, x2, y2)."""
    read = tokens_of(df).select("uid", _writer(threshold, rtl)("tokens").alias("r")).select("uid", "r.n_lines", "r.text")
    return read.select("uid", "n_lines", T.cleanup_text(F.col("text")).alias("pred_text"))
