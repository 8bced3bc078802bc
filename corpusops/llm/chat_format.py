"""Chat formatting by reply trees.

Messages form trees. Self-joins that double their reach give every message its root, depth and summed score; leaves
are ranked by score within their root, and the same jump tables list the messages of each chosen path, which is
formatted as one conversation. A chain of n messages needs log2(n) joins. DataFrame functions only.

Template: ``<turn>role\\ntext</turn>\\n``. In roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;`` (in
roles a line feed becomes ``&#10;``), so no text can hold a marker and the escaping is undone exactly. The loss mask
lists (start, length) in code points of each assistant text in the formatted string.

Null roles and texts count as empty, null scores as 0. Messages with equal ids in a tree keep one copy per row only
if ids are unique; the caller numbers rows, as ``from_turns`` does (ties of turn go by role, then text). A message
whose parent does not exist is a root. Of messages that reply to each other in a ring (or to themselves), the one with
the smallest id becomes a root; ``ring_heads`` lists these. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

OPEN, CLOSE = "<turn>", "</turn>\n"


def from_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each replying to the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("id"), "role", "text"
    ).select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _same(a: str, b: str):
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def _walk(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Jump tables by powers of two, the last table, and the number of doublings.

    Of each message: `up`, the ancestor 2^k above; root, depth and score of the path walked so far, up itself left out.
    """
    own = nodes.alias("n").join(nodes.select("tree", "id").alias("p"), _same("n", "p") & (F.col("n.parent") == F.col("p.id")), "left")
    walked = own.select("n.tree", "n.id", F.col("p.id").alias("up"), F.col("n.id").alias("root"), F.lit(1).cast("long").alias("depth"), "n.score")
    jump = stored(walked, "reach")
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0  # no path is longer
    steps, rounds = [jump.select("tree", "id", "up")], 0
    while 2**rounds <= most and jump.filter("up IS NOT NULL").limit(1).count():
        # paths that have reached their root walk no further
        far = jump.filter("up IS NOT NULL").alias("n").join(jump.alias("u"), _same("n", "u") & (F.col("n.up") == F.col("u.id")))
        farther = far.select("n.tree", "n.id", F.col("u.up").alias("up"), "u.root", (F.col("n.depth") + F.col("u.depth")).alias("depth"), (F.col("n.score") + F.col("u.score")).alias("score"))
        jump = stored(farther.unionByName(jump.filter("up IS NULL")), "reach")
        steps.append(jump.select("tree", "id", "up"))
        rounds += 1
    return steps, jump, rounds


def _heads(steps: list[DataFrame], jump: DataFrame, rounds: int) -> DataFrame:
    """(tree, id): the smallest message of each ring. Paths without end have walked into their ring by now."""
    on = jump.filter("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    ring = stored(on.alias("o").join(steps[0].alias("s"), _same("o", "s") & (F.col("o.id") == F.col("s.id"))).select("o.tree", "o.id", "s.up", F.col("o.id").alias("least")), "ring")
    for _ in range(rounds):
        next_ = ring.alias("r").join(ring.alias("u"), _same("r", "u") & (F.col("r.up") == F.col("u.id")))
        ring = stored(next_.select("r.tree", "r.id", "u.up", F.least("r.least", "u.least").alias("least")), "ring")
    return ring.filter("id = least").select("tree", "id")


def ring_heads(messages: DataFrame) -> DataFrame:
    """(tree, id) of the messages that become roots because they reply to each other in a ring."""
    return _heads(*_walk(messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))))


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, id, depth) for each message of the `best` highest scored root-to-leaf paths of each root."""
    nodes = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    steps, jump, rounds = _walk(nodes)
    if jump.filter("up IS NOT NULL").limit(1).count():
        heads = _heads(steps, jump, rounds).withColumn("head", F.lit(True))
        cut = nodes.alias("n").join(heads.alias("h"), _same("n", "h") & (F.col("n.id") == F.col("h.id")), "left")
        nodes = stored(cut.select("n.tree", "n.id", F.when(F.col("h.head").isNull(), F.col("n.parent")).alias("parent"), "n.score"), "cut")
        steps, jump, rounds = _walk(nodes)
    leaves = jump.alias("n").join(nodes.alias("c"), _same("n", "c") & (F.col("n.id") == F.col("c.parent")), "left_anti")
    ranked = leaves.select("tree", "id", "root", "depth", F.row_number().over(Window.partitionBy("tree", "root").orderBy(F.desc("score"), F.desc("depth"), "id")).alias("rank"))
    members = ranked.filter(F.col("rank") <= best).select("tree", F.col("id").alias("leaf"), "id", "depth")
    for k in range(len(steps) - 2, -1, -1):
        found = members.alias("m").join(steps[k].filter("up IS NOT NULL").alias("s"), _same("m", "s") & (F.col("m.id") == F.col("s.id")))
        members = stored(members.unionByName(found.select("m.tree", "m.leaf", F.col("s.up").alias("id"), (F.col("m.depth") - 2**k).alias("depth"))), "members")
    return members


def escape(text, role: bool = False):
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit("\n"), F.lit("&#10;")) if role else out


def unescape(text, role: bool = False):
    text = F.replace(text, F.lit("&#10;"), F.lit("\n")) if role else text
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, formatted, loss_mask array<struct<start,length>>): one row per path."""
    rows = paths.alias("p").join(messages.alias("m"), _same("p", "m") & (F.col("p.id") == F.col("m.id")))
    head = F.concat(F.lit(OPEN), escape(F.col("m.role"), True), F.lit("\n"))
    rows = rows.select("p.tree", "p.leaf", "p.depth", F.col("m.role").alias("role"), head.alias("head"), escape(F.col("m.text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", F.coalesce(before, F.lit(0)) + F.char_length("head"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "start", F.char_length("body").alias("length"), (F.col("role") == "assistant").alias("loss"))
    turns = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: F.coalesce(t["loss"], F.lit(False))), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return turns.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted):
    """The turns of a formatted conversation: array<struct<role, text>>."""
    pieces = F.split(formatted, OPEN, -1)
    inner = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substring_index(p, "</turn>", 1))
    role = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(inner, lambda p: F.struct(unescape(role(p), True).alias("role"), unescape(F.substring(p, F.char_length(role(p)) + 2, F.char_length(p))).alias("text")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats every conversation and reads the digests back from the formatted text and its mask."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = stored(from_turns(turns), "messages")
    out = format_paths(messages, chosen_paths(messages))
    out = out.select("*", read_turns(F.col("formatted")).alias("read"), F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"]))), "").alias("loss"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(15 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
