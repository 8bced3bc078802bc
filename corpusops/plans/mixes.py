"""Splits, training mixes, text synthesis and streams over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from ..sources import io
from ..streaming import streams
from .fixtures import Inputs
from .fixtures import with_views as W
from .registry import Registry

R = Registry()


@R("split_greedy", W("v_manifest", rest=", g AS (SELECT row_id, count(*) AS n, sha1(CAST(row_id AS VARCHAR)) AS h FROM v_manifest GROUP BY row_id), b AS (SELECT row_id, n, coalesce(sum(n) OVER (ORDER BY h, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, round_even(sum(n) OVER () * 0.8, 0) AS t, round_even(sum(n) OVER () * 0.1, 0) AS v FROM g), f AS (SELECT min(b) AS b0 FROM b WHERE b >= t) SELECT row_id, n, CASE WHEN b < t THEN 'train' WHEN b = b0 OR b - b0 < v THEN 'val' ELSE 'test' END AS split FROM b, f"))
def split_greedy(t: Inputs):
    return S.split_greedy(t.view("v_manifest"), "row_id")


@R("group_split")
def group_split(t: Inputs):
    return S.group_split(t.view("v_manifest"), "row_id", 300)


R.sql["group_split"] = "WITH RECURSIVE g AS (SELECT doc_id % 211 AS row_id, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT row_id, n, row_number() OVER (ORDER BY sha1(CAST(row_id AS VARCHAR)), row_id) AS k, sum(n) OVER () AS total FROM g), w AS (SELECT k, row_id, n, total, CAST(n AS BIGINT) AS seen, (n <= 600 OR total - n < 300) AS validation, CASE WHEN n <= 600 OR total - n < 300 THEN CAST(n AS BIGINT) ELSE CAST(0 AS BIGINT) END AS v FROM o WHERE k = 1 UNION ALL SELECT o.k, o.row_id, o.n, o.total, CAST(w.seen + o.n AS BIGINT), 300 - w.v > 0 AND (o.n <= 2 * (300 - w.v) OR o.total - w.seen - o.n < 300 - w.v), CAST(w.v + CASE WHEN 300 - w.v > 0 AND (o.n <= 2 * (300 - w.v) OR o.total - w.seen - o.n < 300 - w.v) THEN o.n ELSE 0 END AS BIGINT) FROM w JOIN o ON o.k = w.k + 1) SELECT row_id, n, validation FROM w"


def _sources(t: Inputs):
    return t.table("documents").select(F.col("doc_id").alias("uid"), F.when(F.col("doc_id") % 3 == 0, "real").otherwise("synth").alias("source_tag"), "lang")


DENSE = "WITH d AS (SELECT doc_id AS uid, CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'synth' END AS source_tag FROM documents), i AS (SELECT uid, source_tag, row_number() OVER (PARTITION BY source_tag ORDER BY sha1(CAST(uid AS VARCHAR)), uid) - 1 AS row_no, count(*) OVER (PARTITION BY source_tag) AS n FROM d)"


@R("alternating_schedule", f"{DENSE} SELECT uid, row_no // 16 AS batch_no, CASE WHEN source_tag = 'real' THEN row_no // 16 * 4 ELSE row_no // 16 // 3 * 4 + 1 + row_no // 16 % 3 END AS step FROM i")
def alternating_schedule(t: Inputs):
    return S.alternating_schedule(_sources(t), 16, 3).select("uid", "batch_no", "step")


def _mix(real: int, synth: int, seed: int) -> str:
    return f"(SELECT 'real' AS s, unnest(range({real})) AS draw, {seed} AS seed UNION ALL SELECT 'synth', unnest(range({synth})), {seed})"


PICK = "SELECT r.s AS source_tag, r.draw, i.uid{more} FROM r JOIN i ON i.source_tag = r.s AND i.row_no = CAST('0x' || substr(md5(CAST(r.seed AS VARCHAR) || ':' || r.s || ':' || CAST(r.draw AS VARCHAR)), 1, 12) AS BIGINT) % i.n"


@R("weighted_mix", f"{DENSE}, r AS {_mix(751, 250, 42)} {PICK.format(more='')}")
def weighted_mix(t: Inputs):
    """1,001 draws by weights 3 to 1: the largest remainder gets the last one."""
    return S.weighted_mix(_sources(t), {"real": 0.75, "synth": 0.25}, 1001, 42).select("source_tag", "draw", "uid")


@R("curriculum_mix", f"{DENSE}, r AS (SELECT * FROM {_mix(100, 300, 7)} UNION ALL SELECT * FROM {_mix(200, 200, 8)} UNION ALL SELECT * FROM {_mix(300, 100, 9)}) {PICK.format(more=', r.seed - 7 AS epoch')}")
def curriculum_mix(t: Inputs):
    return S.curriculum_mix(_sources(t), 0.75, 0.25, 3, 400, 7).select("source_tag", "draw", "uid", "epoch")


@R("repeat_sources", "SELECT event_id, unnest(range(1, 1 + CAST(greatest(1, round_even(event_id % 4 * 0.1 * 10, 0)) AS INTEGER))) AS replica FROM events")
def repeat_sources(t: Inputs):
    return S.repeat_sources(t.table("events").select("event_id"), F.col("event_id") % 4 * 0.1)


@R("union_sources", "SELECT doc_id AS uid, lang, NULL AS url, 'documents' AS source_tag FROM documents UNION ALL SELECT page_id, NULL, url, 'pages' FROM pages")
def union_sources(t: Inputs):
    return S.union_sources({"documents": t.table("documents").select(F.col("doc_id").alias("uid"), "lang"), "pages": t.table("pages").select(F.col("page_id").alias("uid"), "url")})


def _tagged(t: Inputs):
    rows = _sources(t).select("uid", "source_tag")
    return {s: rows.filter(F.col("source_tag") == s).select("uid") for s in ("real", "synth")}


@R("sequential_phases", "SELECT doc_id AS uid, 'synth' AS source_tag, 0 AS phase_idx, 10 AS epochs FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'synth' END, 1, 90 FROM documents")
def sequential_phases(t: Inputs):
    return S.sequential_phases(_tagged(t), [{"sources": ["synth"], "epochs": 10}, {"sources": ["real", "synth"], "epochs": 90}])


@R("regime_select", "SELECT doc_id AS uid, 'real' AS source_tag FROM documents WHERE doc_id % 3 = 0")
def regime_select(t: Inputs):
    return S.regime_select(_tagged(t), "real")


@R("sample_n", "WITH p AS (SELECT DISTINCT 'img/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.PNG' END AS path FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT path FROM p WHERE path LIKE '%.PNG' ORDER BY md5('42:' || path), path LIMIT 100")
def sample_n(t: Inputs):
    """A bank of 100 images out of a listing, those that the labels name."""
    path = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".PNG"))
    listing, wanted = t.table("documents").select(path.alias("path")), t.table("labels").select(F.concat(F.lit("old/"), path).alias("path"))
    return S.style_paths(listing, 100, 42, wanted)


@R("doc_windows", r"WITH RECURSIVE d AS (SELECT doc_id AS uid, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT uid, w, CAST('0x' || substr(md5('42:' || CAST(uid AS VARCHAR)), 1, 12) AS BIGINT) % len(w) AS start FROM d WHERE len(w) > 0), g AS (SELECT uid, w, start + 1 AS pos, '' AS t, false AS done FROM s UNION ALL SELECT uid, w, pos + 1, CASE WHEN length(n) <= 120 THEN n ELSE t END, length(n) > 120 FROM (SELECT uid, w, pos, t, CASE WHEN t = '' THEN w[pos] ELSE t || ' ' || w[pos] END AS n FROM g WHERE NOT done AND pos <= len(w))), k AS (SELECT uid, max_by(t, length(t)) AS t FROM g GROUP BY uid) SELECT uid, CASE WHEN length(t) >= 20 THEN t END AS snippet FROM k")
def doc_windows(t: Inputs):
    return S.doc_windows(t.table("documents").select(F.col("doc_id").alias("uid"), "text"), 20, 120, 42)


@R("explode_tokens", "WITH w AS (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part) SELECT word, count(*) AS n FROM w WHERE word NOT IN ('', 'red', 'hot') GROUP BY word")
def explode_tokens(t: Inputs):
    return S.explode_lexicon(t.table("part"), "p_name", ["red", "hot"])


def _broken(t: Inputs, column: str):
    rows = t.table("part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("text"))
    return S.seeded_separators(rows, "text", 42).select("uid", column)


WORDS = "w AS (SELECT p_partkey AS uid, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)"


def _roll(salt: str) -> str:
    return f"CAST('0x' || substr(md5('42:{salt}:' || CAST(uid AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 12) AS BIGINT) % 4 = 0"


def _glued(salt: str, other: str) -> str:
    return f"CASE WHEN i = 0 THEN w WHEN {_roll(salt)} THEN {other} || w ELSE ' ' || w END"


@R("intra_word_break", f"WITH {WORDS} SELECT uid, string_agg(CASE WHEN length(w) > 3 AND {_roll('b')} THEN substr(w, 1, 2) || '-' || chr(10) || substr(w, 3) ELSE w END, ' ' ORDER BY i) AS broken FROM w GROUP BY uid")
def intra_word_break(t: Inputs):
    return _broken(t, "broken")


@R("inter_word_newline", f"WITH {WORDS} SELECT uid, string_agg({_glued('l', 'chr(10)')}, '' ORDER BY i) AS lined FROM w GROUP BY uid")
def inter_word_newline(t: Inputs):
    return _broken(t, "lined")


@R("plain_text_augment", f"WITH {WORDS} SELECT uid, string_agg({_glued('p', "''")}, '' ORDER BY i) AS plain FROM w GROUP BY uid")
def plain_text_augment(t: Inputs):
    return _broken(t, "plain")


KINDS = {"seal": {"name": ["l {X:name}", "l {X:name}{SEP}son of {Y:name}"], "royal": ["for the king{SEP}{P:place}", "for the king {N}"]}, "plain": {"plain": ["{X:name}", "{P:place}{SEP}{G:god}"]}}


def _template_sql() -> str:
    """The same choices by CASE over the small table of templates."""
    roll = lambda salt: f"CAST('0x' || substr(md5('42:{salt}:' || CAST(uid AS VARCHAR)), 1, 12) AS BIGINT)"
    rows = ", ".join(f"('{k}', {gi}, '{g}', {ti}, '{x}', {len(groups)}, {len(ts)})" for k, groups in KINDS.items() for gi, (g, ts) in enumerate(groups.items()) for ti, x in enumerate(ts))
    lexicon = "SELECT word, row_number() OVER (ORDER BY sha1(word), word) - 1 AS row_no, count(*) OVER () AS n FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower({c}), '[^a-z0-9]+')) AS word FROM {t}) WHERE word <> ''"
    letters = " || ".join(f"CASE WHEN {roll('G')} % 5 + 3 >= {i} THEN substr('abcdefg', 1 + CAST('0x' || substr(md5('42:G:' || CAST(uid AS VARCHAR) || ':{i}'), 1, 12) AS BIGINT) % 7, 1) ELSE '' END" for i in range(1, 8))
    pick = lambda salt, lex: f"(SELECT word FROM {lex} WHERE row_no = {roll(salt)} % {lex}.n)"
    return (
        f"WITH t(kind, gi, grp, ti, x, ng, nt) AS (VALUES {rows}), ln AS ({lexicon.format(c='p_name', t='part')}), lp AS ({lexicon.format(c='n_name', t='nation')}), d AS (SELECT doc_id AS uid FROM documents), "
        f"a AS (SELECT uid, CASE WHEN {roll('kind')} % 1000000 < 750000 THEN 'seal' ELSE 'plain' END AS kind FROM d), b AS (SELECT DISTINCT uid, a.kind, grp, nt, gi FROM a JOIN t ON t.kind = a.kind AND t.gi = {roll('group')} % t.ng), c AS (SELECT b.uid, b.kind, b.grp, x FROM b JOIN t ON t.kind = b.kind AND t.gi = b.gi AND t.ti = {roll('template')} % b.nt), "
        f"f AS (SELECT uid, kind, grp, replace(replace(replace(replace(replace(replace(x, '{{X:name}}', {pick('X', 'ln')}), '{{Y:name}}', {pick('Y', 'ln')}), '{{P:place}}', {pick('P', 'lp')}), '{{G:god}}', {letters}), '{{N}}', CAST({roll('N')} % 9 + 1 AS VARCHAR)), '{{SEP}}', CASE WHEN {roll('SEP')} % 2 = 0 THEN ' ' ELSE '' END) AS x FROM c) "
        f"SELECT uid, kind, grp AS \"group\", upper(x) AS text FROM f"
    )


@R("template_corpus", _template_sql())
def template_corpus(t: Inputs):
    """Texts of two kinds with weights 3 to 1; one lexicon is empty, so its slot takes random letters."""
    words = lambda table, c: S.explode_lexicon(t.table(table), c, []).select("word")
    lexicons = {"name": words("part", "p_name"), "place": words("nation", "n_name"), "god": words("nation", "n_name").filter("word = ''")}
    ids = t.table("documents").select(F.col("doc_id").alias("uid"))
    return S.template_corpus(ids, {"seal": 3.0, "plain": 1.0}, KINDS, lexicons, 42, letters="abcdefg", normalize=F.upper)


@R("stream_ingest", "SELECT DISTINCT user_id AS uid FROM events WHERE ts IS NOT NULL")
def stream_ingest(t: Inputs):
    """Event times span months, so the delay is as long: no row is late, whatever order the files come in."""
    rows = t.table("events").filter("ts IS NOT NULL").select(F.col("user_id").alias("uid"), F.col("event_id").alias("line_no"), F.col("ts").cast("timestamp").alias("ts"))
    source = io.write_jsonl(rows, io.scratch(t.spark, "stream-in"))
    out = streams.ingest(t.spark, source, "uid LONG, line_no LONG, ts TIMESTAMP", io.scratch(t.spark, "stream-out"), io.scratch(t.spark, "stream-state"), event_time="ts", delay="3650 days")
    return out.select("uid")


@R("stream_best", W("v_epochs", rest=", r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY metric DESC, epoch) AS k FROM v_epochs) SELECT run_id, epoch, metric FROM r WHERE k = 1"))
def stream_best(t: Inputs):
    source = io.write_jsonl(t.view("v_epochs"), io.scratch(t.spark, "best-in"))
    return streams.running_best(t.spark, source, "run_id LONG, epoch LONG, metric DOUBLE", io.scratch(t.spark, "best-out"), io.scratch(t.spark, "best-state"))


@R("normalize_ratios", "SELECT lang, round_even(count(*) * 0.8, 0) AS train, round_even(count(*) * 0.1, 0) AS val FROM documents GROUP BY lang")
def normalize_ratios(t: Inputs):
    """Rows of each language that a split by ratios 8:1:1 aims at."""
    train, val, _ = S.normalize_ratios((8, 1, 1))
    return t.table("documents").groupBy("lang").agg(F.bround(F.count("*") * train).alias("train"), F.bround(F.count("*") * val).alias("val"))


@R("split_safety", W("v_manifest", rest="SELECT count(*) AS shared FROM v_manifest a JOIN v_manifest b ON a.uid = b.uid WHERE a.split = 'train' AND b.split = 'validation'"))
def split_safety(t: Inputs):
    """One source for both sets: two different filters, which share no row."""
    S.split_safety({"split": "train"}, {"split": "validation"}, True)
    m = t.view("v_manifest")
    train, val = m.filter("split = 'train'"), m.filter("split = 'validation'")
    return train.join(val.select("uid").distinct(), "uid", "left_semi").agg(F.count("*").alias("shared"))
