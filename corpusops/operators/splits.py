"""Leak-safe splits, audits, training mixes and text synthesis."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def normalize_ratios(ratios: tuple[float, float, float]) -> tuple[float, ...]:
    if len(ratios) != 3 or min(ratios) < 0 or sum(ratios) <= 0:
        raise ValueError("three ratios with a positive sum are needed")
    return tuple(r / sum(ratios) for r in ratios)


def _order(group: str) -> list[Column]:
    return [F.sha1(F.col(group).cast("string").cast("binary")), F.col(group)]


def _before(sizes: DataFrame, group: str, value: str, out: str, digits: int) -> DataFrame:
    """Adds the sum of value over the groups that come earlier in hash order: inside cells of so many leading hash digits,
    and level by level over the cells. Without digits all groups are one cell."""
    whole = Window.partitionBy(F.lit(0)).orderBy("h", group).rowsBetween(Window.unboundedPreceding, -1)
    if not digits:
        return sizes.filter("h IS NOT NULL").withColumn(out, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    cells = sizes.withColumn("_p", F.substring("h", 1, digits))
    starts = cell_starts(cells.groupBy("_p").agg(F.sum(value).alias("_c")), [], digits)
    inside = Window.partitionBy("_p").orderBy("h", group).rowsBetween(Window.unboundedPreceding, -1)
    summed = cells.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, "_p")
    return summed.withColumn(out, F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")


def _cells(rows: int, width: int) -> int:
    return hash_digits(rows, width) if rows > width else 0


def group_sizes(df: DataFrame, group: str, width: int = 20_000) -> DataFrame:
    """(group, n, h, before): sizes, and the rows of groups that come earlier in hash order, in cells of about `width`
    groups."""
    from ..sources.io import kept

    sizes = kept(df.groupBy(group).agg(F.count("*").alias("n")).withColumn("h", _order(group)[0]), "group-sizes")
    return _before(sizes, group, "n", "before", _cells(sizes.count(), width)).select(group, "n", "h", "before")


def split_greedy(df: DataFrame, group: str, ratios=(0.8, 0.1, 0.1)) -> DataFrame:
    """(group, n, split): groups in hash order fill train, then val, then test."""
    rt, rv, _ = normalize_ratios(ratios)
    sizes = group_sizes(df, group)
    total = sizes.agg(F.sum("n").alias("total"))
    sizes = sizes.crossJoin(total).withColumn("t", F.bround(F.col("total") * rt)).withColumn("v", F.bround(F.col("total") * rv))
    first = sizes.filter("before >= t").agg(F.min("before").alias("b0"))
    b, b0 = F.col("before"), F.col("b0")
    split = F.when(b < F.col("t"), "train").when((b == b0) | (b - b0 < F.col("v")), "val").otherwise("test")
    return sizes.crossJoin(first).select(group, "n", split.alias("split"))


def group_split(df: DataFrame, group: str, target: int, width: int = 20_000) -> DataFrame:
    """(group, n, validation): groups in hash order are taken while that brings the count nearer to the target, or while
    what is left could not reach it.

    A group of n rows is taken if n is at most twice what is needed then, or more than what may still be left out. The
    rule is sequential, but runs of decisions follow from prefix sums: with b the largest size up to what is needed, all
    groups of up to b rows are taken as long as twice what is needed is b or more, and any larger group that is taken ends
    the split. A run's end is one minimum over all groups. What is needed then is less than half of before, so there are
    no more runs than the target has binary digits, as a rule two or three; of each only its end comes to the driver.
    """
    from ..sources.io import kept

    sized = kept(group_sizes(df, group, width), "groups")
    kind, place, n = dict(sized.dtypes)[group], F.struct("h", group), F.col("n")
    rows, total = sized.agg(F.count("*"), F.sum("n")).first()
    digits, need, spare = _cells(rows, width), target, (total or 0) - target
    at = lambda r: F.struct(F.lit(r["h"]), F.lit(r["g"]).cast(kind).alias(group))
    last, taken = None, F.lit(False)
    while need > 0:
        rest = sized.filter(place > at(last)) if last else sized
        bound = rest.filter(n <= need).agg(F.max("n")).first()[0] or 0
        sums = _before(rest.withColumn("_s", F.when(n <= bound, n).otherwise(0)), group, "_s", "small", digits)
        left = F.lit(need) - F.col("small")
        skipped = F.col("before") - (last["before"] + last["n"] if last else 0) - F.col("small")
        ends = F.when(n <= bound, 2 * (left - n) < bound).otherwise((n <= 2 * left) | (n > F.lit(spare) - skipped))
        end = sums.filter(ends).agg(F.min(F.struct("h", F.col(group).alias("g"), "n", "before", "small", skipped.alias("skipped"))).alias("e")).first()["e"]
        run = (place > at(last)) if last else F.lit(True)
        if end is None:
            taken = taken | (run & (n <= bound))
            break
        taken = taken | (run & (place <= at(end)) & ((n <= bound) | (place == at(end))))
        need, spare, last = need - end["small"] - end["n"], spare - end["skipped"], end
    return sized.select(group, "n", taken.alias("validation"))


def split_extract(df: DataFrame, val: tuple[str, ...] = ("val", "validation")) -> dict[str, DataFrame]:
    known = F.lower("split").isin(*val)
    return {"train": df.filter(F.lower("split") == "train"), "val": df.filter(known), "val_ids": df.filter(known).select("row_id").distinct()}


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).filter(F.col(key).isNotNull())


def audit_leak(train: DataFrame, val: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: shared ids, rows without id, and whether the audit passes."""
    shared = overlap(train, val, key).agg(F.count("*").alias("shared"))
    missing = train.select(key).unionAll(val.select(key)).agg(F.count_if(F.col(key).isNull()).alias("missing"))
    return shared.crossJoin(missing).withColumn("passed", (F.col("shared") == 0) & (F.col("missing") == 0))


def release_counts(df: DataFrame, by: str, key: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("records"), F.countDistinct(key).alias("ids"))


def verify_release(df: DataFrame, expected: dict[str, int], key: str = "row_id", tables: dict[str, DataFrame] | None = None, required: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """Check rows (check, level, detail): required tables, counts by split against the expected, ids shared between
    splits, and, with `groups` (key, split), ids that the group split puts elsewhere, which is a warning."""
    spark = df.sparkSession
    rows = []
    for name in required:
        has = name in (tables or {}) and tables[name].limit(1).count() > 0
        rows.append((f"table:{name}", "ok" if has else "error", "present" if has else "missing"))
    extra = spark.createDataFrame(rows, "check string, level string, detail string")
    if groups is not None:
        moved = df.select(key, "split").distinct().join(groups.select(key, F.col("split").alias("want")), key).agg(F.count_if(F.col("split") != F.col("want")).alias("n"))
        extra = extra.unionByName(moved.select(F.lit("group_split").alias("check"), F.when(F.col("n") == 0, "ok").otherwise("warning").alias("level"), F.col("n").cast("string").alias("detail")))
    want = spark.createDataFrame(list(expected.items()), "split string, want long")
    have = df.groupBy("split").agg(F.count("*").alias("have"))
    counts = want.join(have, "split", "left").select(F.concat(F.lit("count:"), "split").alias("check"), F.when(F.coalesce("have", F.lit(0)) == F.col("want"), "ok").otherwise("error").alias("level"), F.coalesce("have", F.lit(0)).cast("string").alias("detail"))
    sets = split_extract(df)
    leak = audit_leak(sets["train"], sets["val"], key)
    return extra.unionByName(counts).unionByName(leak.select(F.lit("leak").alias("check"), F.when(F.col("passed"), "ok").otherwise("error").alias("level"), F.col("shared").cast("string").alias("detail")))


def split_safety(train_filter: dict, val_filter: dict, same_source: bool) -> None:
    if same_source and (not train_filter or not val_filter or train_filter == val_filter):
        raise ValueError("one source for train and val needs two different filters")


REGIMES = {"real": ["real"], "synth": ["synth"], "mixed": ["real", "synth"]}


def regime_select(sources: dict[str, DataFrame], regime: str, regimes: dict[str, list[str]] | None = None) -> DataFrame:
    """The union of a regime's sources, each row tagged; unknown names raise."""
    names = (regimes or REGIMES).get(regime)
    if names is None or set(names) - set(sources):
        raise ValueError(f"unknown regime or source: {regime}")
    return union_sources({n: sources[n] for n in names})


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("source_tag", F.lit(name)) for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def hash_digits(rows: int, width: int = 20_000) -> int:
    """Leading hex digits of a hash that deal so many rows into cells of about `width` rows; an even number of at least 2."""
    digits = 2
    while 16**digits * width < rows:
        digits += 2
    return digits


def cell_starts(counts: DataFrame, by: list[str], digits: int) -> DataFrame:
    """(by, _p, _b) from sums _c of cells _p of so many hash digits: what comes before each cell inside its `by`.

    Two digits at a time, so that no window sees more than 256 sums.
    """
    base = counts.select(*by, "_p", F.lit(0).cast("long").alias("_b"))
    for d in range(2, digits + 1, 2):
        level = counts.groupBy(*by, F.substring("_p", 1, d).alias("_l")).agg(F.sum("_c").alias("_c"))
        w = Window.partitionBy(*by, F.substring("_l", 1, d - 2)).orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(*[F.col(c).alias(f"_{c}") for c in by], "_l", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o"))
        on = F.substring("_p", 1, d) == F.col("_l")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        base = base.join(before, on).select(*by, "_p", (F.col("_b") + F.col("_o")).alias("_b"))
    return base


def dense_index(df: DataFrame, by: str, key: str, width: int = 20_000) -> DataFrame:
    """Adds row_no from 0 inside each `by`, in order of the hash of key.

    Rows are numbered inside cells of equal leading hash digits, as many digits as the number of rows asks for; cells are
    summed up level by level, two digits at a time, so that no window sees more than 256 sums or a cell's rows.
    """
    digits = hash_digits(df.count(), width)
    rows = df.withColumn("_h", F.sha1(F.col(key).cast("string").cast("binary"))).withColumn("_p", F.substring("_h", 1, digits))
    base = cell_starts(rows.groupBy(by, "_p").agg(F.count("*").alias("_c")), [by], digits)
    inside = F.row_number().over(Window.partitionBy(by, "_p").orderBy("_h", key)) - 1
    return rows.withColumn("_i", inside).join(base, [by, "_p"]).withColumn("row_no", F.col("_b") + F.col("_i")).drop("_h", "_p", "_b", "_i")


def quotas(weights: dict[str, float], draws: int) -> dict[str, int]:
    """Whole shares of `draws` that add up to it: what rounding down leaves goes to the largest remainders."""
    total = sum(weights.values())
    exact = {s: draws * w / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: draws - sum(out.values())]:
        out[s] += 1
    return out


#: Draws that one row stands for at most.
DRAWS = 100_000


def _drawn(df: DataFrame, plan: list[tuple], by: str, key: str) -> DataFrame:
    """Rows of (epoch, seed, source, quota): draw j of a source takes row md5(seed:source:j) mod n of it."""
    quota = df.sparkSession.createDataFrame(plan, f"epoch int, seed long, {by} string, quota long").filter("quota > 0")
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    # in chunks, dealt out before they are drawn
    starts = quota.join(sizes, by).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1, F.lit(DRAWS).cast("long"))).alias("from"))
    dealt = starts.repartition(F.xxhash64("epoch", by, "from")) if sum(q for *_, q in plan) > DRAWS else starts
    rolls = dealt.select("epoch", "seed", by, "n", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + DRAWS, F.col("quota")) - 1)).alias("draw"))
    digest = F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col(by), F.col("draw").cast("string")).cast("binary"))
    rolls = rolls.withColumn("row_no", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.col("n")).drop("n", "seed")
    return rolls.join(dense_index(df, by, key), [by, "row_no"])


def weighted_mix(df: DataFrame, weights: dict[str, float], draws: int, seed: int, by: str = "source_tag", key: str = "uid") -> DataFrame:
    """`draws` rows with replacement; sources of the weights that have no row give none."""
    there = {r[by] for r in df.select(by).distinct().filter(F.col(by).isin(list(weights))).collect()}
    known = {s: w for s, w in weights.items() if s in there and w > 0}
    return _drawn(df, [(0, seed, s, n) for s, n in quotas(known, draws).items()] if known else [], by, key).drop("epoch")


def curriculum_mix(df: DataFrame, start: float, end: float, epochs: int, draws: int, seed: int) -> DataFrame:
    """A weighted mix for each epoch, the share of synth going linearly from start to end; all epochs in one join."""
    plan = []
    for e in range(epochs):
        f = end if epochs <= 1 else start + (end - start) * e / (epochs - 1)
        plan += [(e, seed + e, s, n) for s, n in quotas({"synth": max(f, 1e-6), "real": max(1 - f, 1e-6)}, draws).items()]
    return _drawn(df, plan, "source_tag", "uid")


def repeat_sources(df: DataFrame, weight: Column) -> DataFrame:
    """Each row max(1, round(10 w)) times, with a replica number from 1."""
    return df.withColumn("replica", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.bround(weight * 10).cast("int")))))


def alternating_schedule(df: DataFrame, batch: int, synth_per_real: int, by: str = "source_tag", key: str = "uid") -> DataFrame:
    """Adds batch_no and step: one real batch, then synth_per_real synthetic ones."""
    rows = dense_index(df, by, key).withColumn("batch_no", F.floor(F.col("row_no") / batch).cast("long"))
    k = synth_per_real
    b = F.col("batch_no")
    return rows.withColumn("step", F.when(F.col(by) == "real", b * (k + 1)).otherwise(F.floor(b / k) * (k + 1) + 1 + b % k).cast("long"))


def sequential_phases(sources: dict[str, DataFrame], phases: list[dict]) -> DataFrame:
    parts = [union_sources({s: sources[s] for s in p["sources"]}).withColumn("phase_idx", F.lit(i)).withColumn("epochs", F.lit(p["epochs"])) for i, p in enumerate(phases)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sample_n(df: DataFrame, n: int, seed: int, key: str = "uid") -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp")


def style_paths(listing: DataFrame, n: int, seed: int, manifest: DataFrame | None = None, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """(path): n image paths chosen by hash, without repeats. With a manifest (path) only its paths that the listing has,
    or that the listing has below another folder, count; else all of the listing."""
    known = listing.select("path").distinct()
    if manifest is not None:
        short = F.regexp_replace("path", r"^(.*/)?([^/]+/[^/]+)$", "$2")
        wanted = manifest.select(short.alias("short")).distinct()
        known = known.join(wanted, short == F.col("short"), "left_semi")
    images = known.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    return sample_n(images, n, seed, "path")


def head_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def merge_last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    last = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return last.select(key, "r.*")


def distinct_ordered(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias("first"))


def doc_windows(docs: DataFrame, low: int, high: int, seed: int, key: str = "uid", text: str = "text") -> DataFrame:
    """(key, snippet): words from a hashed start while they fit in high characters; null if shorter than low."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).filter(F.size("w") > 0)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rows = rows.withColumn("start", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.size("w")).cast("int"))
    # a word and its blank take two characters at least, so no more than high / 2 + 1 words can fit
    part = F.slice("w", F.col("start") + 1, high // 2 + 1)
    grow = F.aggregate(part, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")), lambda a, w: F.when(a["full"] | (F.length(a["t"]) + F.length(w) + 1 > high + F.when(a["t"] == "", 1).otherwise(0)), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.when(a["t"] == "", w).otherwise(F.concat(a["t"], F.lit(" "), w)).alias("t"), F.lit(False).alias("full"))), lambda a: a["t"])
    return rows.select(key, grow.alias("s")).select(key, F.when(F.length("s") >= low, F.col("s")).alias("snippet"))


def explode_lexicon(df: DataFrame, text: str, drop: list[str]) -> DataFrame:
    w = df.select(F.explode(F.split(F.lower(text), r"[^a-z0-9]+")).alias("word"))
    return w.filter((F.col("word") != "") & ~F.col("word").isin(*drop)).groupBy("word").agg(F.count("*").alias("n"))


def _digest(*what) -> Column:
    """48 bits of the MD5 of the values joined by colons, as a number."""
    joined = F.concat_ws(":", *[(F.lit(str(x)) if not isinstance(x, Column) else x.cast("string")) for x in what])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 12), 16, 10).cast("long")


def seeded_separators(df: DataFrame, text: str, seed: int, key: str = "uid") -> DataFrame:
    """Adds broken (a hyphen break inside some words), lined (some blanks as line feeds) and plain (some blanks gone)."""
    words = F.split(text, " ")
    roll = lambda i, salt: _digest(seed, salt, F.col(key), i) % 4
    broken = F.array_join(F.transform(words, lambda w, i: F.when((F.length(w) > 3) & (roll(i, "b") == 0), F.concat(F.substring(w, 1, 2), F.lit("-\n"), F.substring(w, F.lit(3), F.length(w)))).otherwise(w)), " ")
    glue = lambda salt, other: F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).when(roll(i, salt) == 0, F.concat(F.lit(other), w)).otherwise(F.concat(F.lit(" "), w))), "")
    return df.withColumn("broken", broken).withColumn("lined", glue("l", "\n")).withColumn("plain", glue("p", ""))


def template_corpus(ids: DataFrame, kinds: dict[str, float], groups: dict[str, dict[str, list[str]]], lexicons: dict[str, DataFrame], seed: int, key: str = "uid", letters: str = T.LETTERS, finals: bool = False, normalize=None) -> DataFrame:
    """(key, kind, group, text): a text for each id, all choices by hash of (seed, salt, id).

    kinds: weights of document kinds; groups: of each kind, its template groups; a group is chosen first, then one of its
    templates. A slot {NAME:LEXICON} takes a word of that lexicon (column word), a slot {N} a digit from 1 to 9, {SEP} a
    blank or nothing. A lexicon without words gives 3 to 7 of `letters`. normalize(text) -> Column is applied to the
    result; `finals` then puts final forms at the ends of words.
    """
    spark, total = ids.sparkSession, sum(kinds.values())
    if total <= 0:
        raise ValueError("a kind needs a positive weight")
    bounds, upto = [], 0.0
    for k, w in kinds.items():
        upto += w
        bounds.append((k, round(1_000_000 * upto / total)))
    roll = _digest(seed, "kind", F.col(key)) % 1_000_000
    kind = F.when(roll < bounds[0][1], bounds[0][0])
    for k, top in bounds[1:]:
        kind = kind.when(roll < top, k)
    rows = ids.select(key, kind.alias("kind"))
    table = [(k, gi, g, ti, t, len(groups[k]), len(ts)) for k in groups for gi, (g, ts) in enumerate(groups[k].items()) for ti, t in enumerate(ts)]
    known = spark.createDataFrame(table, "kind string, gi long, group string, ti long, template string, n_groups long, n_templates long")
    sizes = F.broadcast(known.select("kind", "n_groups").distinct())
    rows = rows.join(sizes, "kind").withColumn("gi", _digest(seed, "group", F.col(key)) % F.col("n_groups")).drop("n_groups")
    rows = rows.join(F.broadcast(known.select("kind", "gi", "group", "n_templates").distinct()), ["kind", "gi"])
    rows = rows.withColumn("ti", _digest(seed, "template", F.col(key)) % F.col("n_templates"))
    rows = rows.join(F.broadcast(known.select("kind", "gi", "ti", F.col("template").alias("text"))), ["kind", "gi", "ti"]).select(key, "kind", "group", "text")
    slots = sorted({x for *_, t, _, _ in table for x in re.findall(r"\{(\w+:\w+)\}", t)})
    for slot in slots:
        name, lexicon = slot.split(":")
        words = lexicons[lexicon]
        n = words.count()
        if n:
            indexed = dense_index(words.select(F.lit(1).alias("all"), "word"), "all", "word").select(F.col("row_no").alias("pick"), F.col("word").alias("filler"))
            has = F.contains("text", F.lit("{" + slot + "}"))
            filled = rows.withColumn("pick", F.when(has, _digest(seed, name, F.col(key)) % n)).join(indexed, "pick", "left").drop("pick")
        else:
            size = _digest(seed, name, F.col(key)) % 5 + 3
            chars = F.transform(F.sequence(F.lit(1).cast("long"), size), lambda i: F.substring(F.lit(letters), (_digest(seed, name, F.col(key), i) % len(letters)).cast("int") + 1, F.lit(1)))  # noqa: B023
            filled = rows.withColumn("filler", F.array_join(chars, ""))
        rows = filled.withColumn("text", F.when(F.col("filler").isNull(), F.col("text")).otherwise(F.replace("text", F.lit("{" + slot + "}"), F.col("filler")))).drop("filler")
    text = F.replace("text", F.lit("{N}"), (_digest(seed, "N", F.col(key)) % 9 + 1).cast("string"))
    text = F.replace(text, F.lit("{SEP}"), F.when(_digest(seed, "SEP", F.col(key)) % 2 == 0, " ").otherwise(""))
    text = normalize(text) if normalize else text
    return rows.withColumn("text", T.apply_final_forms(text) if finals else text)
