"""Fuzzy line dedup by MinHash. DataFrame functions only.

Lines are trimmed and lower-cased; a distinct line is named by two XXH64 hashes of this normal form and then by a
number, so exact copies are one node. Lines of `shortest` characters or more are nodes; those of at least MIN_CHARS are
also compared by their shingles, all overlapping substrings of 8 characters.

Signatures are BANDS bands of ROWS minima of shingle hashes under xor with fixed constants. Long lines take minima over
a sample of their shingles, those whose hash has its lowest bits 0; a line near the length where the sampling rate
changes has a signature at both rates, so that similar lines meet at one of them. (Where no shingle falls in the
sample, the first ones stand in.) The sample only finds candidates: similarities count all shingles.

Every pair of lines that share a bucket is verified or excluded by an exact bound: members are first compared with one
member of the bucket, and the links' components computed; buckets of several components are compared with two more of
their members of another component, HUB_ROUNDS times or until none is left; then all pairs that are still of different components are compared, large buckets in blocks. Bounds are
the ratio of set sizes, and the Hamming distance of 1,024-bit parity sketches, which is never more than the size of the symmetric difference. Pairs that pass and whose Jaccard similarity over the 64-bit
hashes of all shingles is at least 0.8 are links; distributed connected components make groups; the first line of each
group, by doc_id and line number, is kept.

Null texts have no lines; blank lines are always kept. Null doc_ids count as one document that comes last. Rows that
repeat a doc_id count as one document: what is removed from one is removed from each. An empty table gives an empty
result. Extra columns ride along in `dedup_lines`, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free_name, parts, stored, table

MIN_CHARS, SIMILAR, BANDS, ROWS, SHINGLE = 20, 0.8, 5, 3, 8
#: Sampling rates 1, 1/4, 1/16 of shingles; lines change over from one to the next within these lengths.
OVERLAPS = [(160, 200), (640, 800)]
STAND_IN = 16
#: Lines of a bucket that are compared in one block; parity sketch in words of 64 bits.
BLOCK, WORDS, HUB_ROUNDS = 1024, 16, 1
SKETCH = ["n", *[f"p{i}" for i in range(WORDS)]]
LAST = (1 << 63) - 1


def _lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, line_no, line, a, b): every line that is not blank, in normal form, and its two hashes."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.filter(F.col("line").rlike(r"\S")).select("doc_id", "line_no", F.lower(F.trim("line")).alias("line"))
    lines = lines.filter(F.char_length("line") >= shortest) if shortest > 1 else lines
    return lines.select("*", *_names("line"))


def _names(line: str) -> list:
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), F.col(line)).alias("b")]


def _place():
    """doc_id and line_no as one number in their order."""
    doc = F.coalesce("doc_id", F.lit(LAST)).cast("decimal(19,0)")
    return doc * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")


def _unplace(at: str) -> list:
    doc = F.floor(F.col(at) / F.lit(1 << 31).cast("decimal(10,0)")).cast("decimal(19,0)")
    return [doc.cast("long").alias("doc_id"), (F.col(at) - doc * F.lit(1 << 31).cast("decimal(10,0)")).cast("int").alias("line_no")]


def _hash_at(at: str = "at"):
    """Hash of the shingle from byte `at`, counted from 1, of u, a line of four bytes a character."""
    return F.expr(f"xxhash64(substring(u, {at}, {4 * SHINGLE}))")


def _constants() -> list[int]:
    return [(j * 0x9E3779B97F4A7C15 % (1 << 64)) >> 2 for j in range(1, BANDS * ROWS + 1)]


def signatures(lines: DataFrame) -> DataFrame:
    """(a, b, rate, k0...): band keys of each distinct line of at least MIN_CHARS, at one or two sampling rates."""
    # what is needed of each shingle is made once a line, as a column of its own
    n = F.col("n")
    rates = F.when(n < MIN_CHARS, F.lit(None).cast("array<int>")).when(n < OVERLAPS[0][0], F.array(F.lit(0)))
    for r, (low, high) in enumerate(OVERLAPS):
        rates = rates.when(n < high, F.array(F.lit(r), F.lit(r + 1)))
        if r + 1 < len(OVERLAPS):
            rates = rates.when(n < OVERLAPS[r + 1][0], F.array(F.lit(r + 1)))
    rates = rates.otherwise(F.array(F.lit(len(OVERLAPS))))
    rows = lines.select("a", "b", "line", F.char_length("line").alias("n"))
    # a null rate is dropped after the explosion; a filter on n would go below it and make the line again
    rows = rows.select("a", "b", "n", F.encode("line", "UTF-32").alias("u"), F.explode_outer(rates).alias("rate")).filter("rate IS NOT NULL")
    rows = rows.select("a", "b", "rate", F.expr("shiftleft(1L, 2 * rate) - 1").alias("mask"), "u", (4 * (n - SHINGLE) + 1).alias("last"))
    at = F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4))).alias("at")
    # the task's number keeps the filter above the hash, which would else be made twice
    rows = rows.select("a", "b", "rate", "mask", "u", at).select("a", "b", "rate", "mask", "at", _hash_at().alias("h"), F.spark_partition_id().alias("task"))
    sampled = F.col("h").bitwiseAND(F.col("mask")) == 0
    # of the two lowest bits, which the sample sets, nothing remains; bit 62 marks what is not sampled
    rows = rows.filter((sampled | (F.col("at") <= 4 * STAND_IN)) & (F.col("task") >= 0)).select("a", "b", "rate", F.shiftrightunsigned("h", 2).bitwiseOR(F.when(sampled, F.lit(0).cast("long")).otherwise(F.lit(1 << 62))).alias("h"))
    minima = [F.min(F.col("h").bitwiseXOR(F.lit(c))).alias(f"m{j}") for j, c in enumerate(_constants())]
    out = rows.groupBy("a", "b", "rate").agg(*minima)
    return out.select("a", "b", "rate", *[F.xxhash64(F.lit(k), F.col("rate"), *[f"m{k * ROWS + i}" for i in range(ROWS)]).alias(f"k{k}") for k in range(BANDS)])


def buckets(bands: DataFrame) -> DataFrame:
    """(key, node, x, size) of (node, k0...): members of buckets of two or more, with the least of them."""
    each = bands.select("node", F.explode(F.array(*[f"k{k}" for k in range(BANDS)])).alias("key"))
    ends = each.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("size"))
    return each.join(ends.filter("x < y").drop("y").repartition(parts(bands)).hint("merge"), "key").distinct()


def _possible(a: str, b: str):
    """False only where the similarity is certainly below SIMILAR: |A xor B| <= (|A| + |B|) (1 - s) / (1 + s)."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}.p0").bitwiseXOR(F.col(f"{b}.p0"))))
    sizes = F.least(f"{a}.n", f"{b}.n") >= SIMILAR * F.greatest(f"{a}.n", f"{b}.n") - 1e-6
    return sizes & (apart <= total * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6)


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of nodes (node, a, b, first), looked up in their documents."""
    wanted = nodes.select("node", "a", "b", *_unplace("first"))
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "node", "a", "b")).alias("wanted"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    lines = texts.join(by_doc, "doc_id").select("wanted", F.split("text", "\n", -1).alias("lines"))
    # the array is made in a step of its own: with a higher-order function inside, the explosion is interpreted row by row
    lines = lines.select(F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), w["a"].alias("wa"), w["b"].alias("wb"), F.lower(F.trim(F.get("lines", w["line_no"]))).alias("line"))).alias("found")).select(F.explode_outer("found").alias("w")).select("w.*")
    # rows that repeat a doc_id may have another line there
    lines = lines.select("*", *_names("line")).filter("a = wa AND b = wb")
    return lines.select("node", "line").dropDuplicates(["node"])


def _shingles(line):
    """The hashes of all shingles in order. The encoded line is an array's only element, so that it is made once."""
    size = F.lit(4 * SHINGLE)
    hashes = lambda u: F.transform(F.sequence(F.lit(1), (F.char_length(line) - SHINGLE) * 4 + 1, F.lit(4)), lambda i: F.xxhash64(F.substring(u, i, size)))
    return F.get(F.transform(F.array(F.encode(line, "UTF-32")), hashes), F.lit(0))


def sketches(texts: DataFrame) -> DataFrame:
    """(node, n, p0...) of (node, line): number of shingles and parity sketch."""
    rows = texts.select("node", F.array_distinct(_shingles(F.col("line"))).alias("hashes")).select("node", F.explode_outer("hashes").alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.shiftright("h", 6).bitwiseAND(WORDS - 1)
    parity = [F.coalesce(F.bit_xor(F.when(word == i, bit)), F.lit(0).cast("long")).alias(f"p{i}") for i in range(WORDS)]
    return rows.groupBy("node").agg(F.count("*").alias("n"), *parity)


def new_hubs(members: DataFrame, groups: DataFrame, salt: int) -> DataFrame:
    """(key, node, first, x, y) for members (key, node, first) of buckets of several components: two of the bucket's
    members by hash. Null where the pair needs no look: of one component, or with the first, which all have been compared
    with."""
    named = members.join(groups, "node", "left").select("key", "node", "first", F.coalesce("component", "node").alias("group"))
    order, end = F.xxhash64("node", "key", F.lit(salt)), F.struct("node", "group")
    hubs = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.min_by(end, order).alias("x"), F.max_by(end, order).alias("y"))
    both = named.join(hubs.filter("lo <> hi").select("key", "x", "y").repartition(parts(members)).hint("merge"), "key")
    new = lambda hub: (F.col("group") != F.col(f"{hub}.group")) & (F.col("first") != F.col("node")) & (F.col("first") != F.col(f"{hub}.node"))
    return both.select("key", "node", "first", *[F.when(new(hub), F.col(f"{hub}.node")).alias(hub) for hub in "xy"])


def hub_pairs(members: DataFrame, made: DataFrame, hubs: list[str]) -> DataFrame:
    """(a, b, na, nb): possible pairs of members with the hubs of their bucket, columns beside node, and their sizes."""
    pairs = members.select("node", F.explode(F.array(*hubs)).alias("end")).filter("node <> end")
    pairs = pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    l, r = (made.select(*[F.col(c).alias(f"{s}_{c}") for c in made.columns]).repartition(parts(made)).hint("merge") for s in "lr")
    pairs = pairs.join(l, F.col("a") == F.col("l_node")).join(r, F.col("b") == F.col("r_node"))
    sides = pairs.select("a", "b", *[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in SKETCH]).alias(s) for s in "lr"])
    return sides.filter(_possible("l", "r")).select("a", "b", F.col("l.n").alias("na"), F.col("r.n").alias("nb"))


def other_pairs(members: DataFrame, made: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b, na, nb): all other possible pairs of a bucket's members, without those of one component."""
    named = members.select("key", "node").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    several = named.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    mixed = named.join(several.select("key", "size").repartition(parts(members)).hint("merge"), "key").join(made, "node")
    mixed = stored(mixed, "line-crowds")
    # each pair of blocks of a bucket meets once
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select("key", "node", "group", "own", *SKETCH, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    l, r = dealt.alias("l"), dealt.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
    # of one block's own pairs each comes once; of two blocks', the first is on the left
    order = F.when(F.col("l.i") == F.col("l.j"), F.col("l.node") < F.col("r.node")).otherwise((F.col("l.own") == F.col("l.i")) & (F.col("r.own") == F.col("r.j")))
    pairs = l.join(r.hint("merge"), same[0] & same[1] & same[2] & order & (F.col("l.group") != F.col("r.group")) & _possible("l", "r"))
    ends = [F.struct(f"{s}.node", f"{s}.n") for s in "lr"]
    pairs = pairs.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
    return pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb), those whose similarity over all shingles is high enough."""
    one, two = (texts.select(F.col("node").alias(s), F.col("line").alias(f"line_{s}")).repartition(parts(texts)).hint("merge") for s in "ab")
    both = pairs.join(one, "a").join(two, "b")
    # the common part has no repeats
    shared = F.size(F.array_intersect(_shingles(F.col("line_a")), _shingles(F.col("line_b"))))
    # shared >= SIMILAR * (na + nb - shared), with shared once: a filter makes it anew for each mention
    return both.filter(shared * (1 + SIMILAR) >= SIMILAR * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links that have the components of all pairs of similar lines in one bucket."""
    members = stored(buckets(nodes.filter("k0 IS NOT NULL")), "line-bands")
    involved = members.select("node").distinct()
    texts = stored(texts_of(docs, nodes.join(involved, "node", "left_semi").dropDuplicates(["node"])), "line-texts")
    made = stored(sketches(texts), "line-sketches")
    first = stored(verified(hub_pairs(members, made, ["x"]), texts), "line-links")
    groups = stored(components(first), "line-groups")
    several = members.filter("size > 2").select("key", "node", F.col("x").alias("first"))  # two that are not similar have been compared
    for k in range(HUB_ROUNDS):
        several = stored(new_hubs(several, groups, k), "line-hubs")
        if not several.limit(1).count():
            break
        found = verified(hub_pairs(several, made, ["x", "y"]), texts)
        tied = groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = stored(components(tied.unionByName(found)), "line-groups")
    tied = groups.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return tied.unionByName(verified(other_pairs(several.select("key", "node"), made, groups), texts))


def removed_lines(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of each line that goes; below MIN_CHARS only exact copies go."""
    lines = _lines(docs, shortest)
    found = stored(lines.select("doc_id", "line_no", "a", "b"), "lines")
    each = found.groupBy("a", "b").agg(F.min(_place()).alias("first"), F.count("*").alias("copies"))
    each = each.withColumn("node", F.monotonically_increasing_id())
    nodes = stored(each.join(signatures(lines), ["a", "b"], "left").drop("rate"), "line-nodes")
    groups = components(links(docs, nodes))
    named = nodes.select("node", "a", "b", "first", "copies").dropDuplicates(["node"]).join(groups, "node", "left").filter("copies > 1 OR component IS NOT NULL")
    named = stored(named.select("a", "b", "first", F.coalesce("component", "node").alias("group")), "line-first")
    least = named.groupBy("group").agg(F.min("first").alias("kept"))
    kept = named.join(least, "group").select("a", "b", "kept")
    out = found.join(kept.repartition(parts(docs)).hint("merge"), ["a", "b"]).filter(_place() != F.col("kept"))
    out = out.select("doc_id", "line_no", F.struct(*_unplace("kept")).alias("kept"))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").cast("long").alias("kept_line_no"))


def dedup_lines(docs: DataFrame, shortest: int = MIN_CHARS) -> DataFrame:
    """docs with the removed lines cut out of text; texts that lose no line stay as they are."""
    gone = free_name(docs, "gone")
    by_doc = removed_lines(docs, shortest).select("doc_id", "line_no").groupBy("doc_id").agg(F.collect_set("line_no").alias(gone))
    joined = docs.alias("d").join(by_doc.alias("g"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")), "left").select("d.*", f"g.{gone}")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i.cast("long"))), "\n")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)).select(docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that repeats, exactly or nearly, an earlier line of the corpus."""
    return removed_lines(table(spark, sf_dir, "documents"), shortest=1)
