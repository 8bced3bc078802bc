"""Column functions over text: variants, normal forms, keys and edit distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 22 letters, the final forms and their base letters, and the letters' names.
LETTERS = "אבגדהוזחטיכלמנסעפצקרשת"
FINALS, BASES = "ךםןףץ", "כמנפצ"
NAMES = "aleph bet gimel dalet he vav zayin het tet yod kaf lamed mem nun samekh ayin pe tsadi qof resh shin tav".split()
UNKNOWN = "[?]"


def blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def text_variants(text: Column) -> Column:
    """struct<raw, stripped, collapsed_ws, no_space, no_brackets>; all null for null."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.replace(F.replace(stripped, F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
    return F.struct(text.alias("raw"), stripped.alias("stripped"), blanks(text).alias("collapsed_ws"), F.regexp_replace(text, r"\s+", "").alias("no_space"), blanks(plain).alias("no_brackets"))


def normalize_script(text: Column, letters: str = LETTERS, finals: str = FINALS, bases: str = BASES, marks: str = "֑-ׇ", keep_marks: bool = False, newlines: bool = True, letters_only: bool = False) -> Column:
    """Marks go, final forms become base letters, characters outside the script become blanks, blanks collapse."""
    out = text if keep_marks else F.regexp_replace(text, f"[{marks}]", "")
    out = F.translate(out, finals, bases)
    more = (marks if keep_marks else "") + ("\n" if newlines else "") + ("" if letters_only else " ")
    out = F.regexp_replace(out, f"[^{letters}{more}]", "" if letters_only else " ")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, " *\n *", "\n") if newlines else out
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def apply_final_forms(text: Column, min_len: int = 2, bases: str = BASES, finals: str = FINALS, letters: str = "א-ת") -> Column:
    """The last letter of each run of at least min_len letters takes its final form."""
    for base, final in zip(bases, finals):
        text = F.regexp_replace(text, f"([{letters}]{{{min_len - 1}}}){base}([^{letters}]|$)", f"$1{final}$2")
    return text


def normalize_letter(text: Column, letters: str = LETTERS, finals: str = FINALS, bases: str = BASES) -> Column:
    out = F.translate(F.trim(text), finals, bases)
    return F.when(out.isin(*letters), out)


def class_name(letter: Column, letters: str = LETTERS, names: list[str] | None = None) -> Column:
    """NN_name_letter."""
    pairs = [F.lit(x) for k, (c, n) in enumerate(zip(letters, names or NAMES), 1) for x in (c, f"{k:02d}_{n}_{c}")]
    return F.element_at(F.create_map(*pairs), letter)


def script_ratio(text: Column, chars: str = "֐-׿") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[{chars}]")) / F.greatest(F.lit(1), F.length(text)), F.lit(0.0))


def safe_stem(text: Column, longest: int = 180, extra: str = "") -> Column:
    return F.substring(F.regexp_replace(text, f"[^0-9A-Za-z_.{extra}-]+", "_"), 1, longest)


def uid_key(manifest: Column, uid: Column) -> Column:
    return F.concat_ws("_", F.substring(F.md5(manifest.cast("binary")), 1, 8), safe_stem(uid.cast("string")))


def cleanup_text(text: Column) -> Column:
    """One pass over doubled unknown markers; bars and slashes become blanks; blanks collapse."""
    out = F.replace(text, F.lit(UNKNOWN * 2), F.lit(UNKNOWN))
    return blanks(F.replace(F.replace(out, F.lit("|"), F.lit(" ")), F.lit("/"), F.lit(" ")))


def postprocess_pred(text: Column, flipped: Column) -> Column:
    return F.when(F.coalesce(flipped, F.lit(False)), F.reverse(F.trim(text))).otherwise(F.trim(text))


def join_tokens(chars: Column) -> Column:
    return F.array_join(F.transform(chars, lambda c: F.when(c == "?", UNKNOWN).otherwise(c)), "")


def parse_weights(text: Column, keys: list[str]) -> Column:
    """"a:0.7,b:0.2" as an array of doubles in the order of keys: missing and negative are 0; null if all are 0."""
    given = F.str_to_map(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(":"))
    out = F.array(*[F.greatest(F.lit(0.0), F.coalesce(F.element_at(given, k).try_cast("double"), F.lit(0.0))) for k in keys])
    return F.when(F.exists(out, lambda x: x > 0), out)


def numeric_or_nan(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan")))


def shard_of(uid: Column, n: int) -> Column:
    """md5 as a 128-bit integer modulo n."""
    digest = F.md5(uid.cast("string").cast("binary"))
    chunks = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda r, c: (r * (1 << 32) + c) % n).cast("int")


def style_index(uid: Column, n: int) -> Column:
    return (F.conv(F.substring(F.md5(uid.cast("string").cast("binary")), 1, 2), 16, 10).cast("int") % n).cast("int")


def stable_seed(uid: Column, base: int) -> Column:
    d = F.md5(uid.cast("string").cast("binary"))
    swapped = F.concat(*[F.substring(d, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long") + base


def canonical_key(fields: dict[str, Column], length: int = 20) -> Column:
    """sha256 of the JSON of the named fields in order of their names, whatever order they are given in."""
    named = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.substring(F.sha2(F.to_json(named).cast("binary"), 256), 1, length)


def route_prompt(mode: Column, kind: Column, density: Column, limit: float = 0.18) -> Column:
    by_kind = F.when(kind == "dense", "dense").otherwise("plain")
    return F.when(mode == "fixed", "plain").when(mode == "by_doc_kind", by_kind).otherwise(F.when(density >= limit, "dense").otherwise("plain"))


def curriculum_fraction(epoch: Column, total: int, start: float, end: float) -> Column:
    if total <= 1:
        return F.lit(float(end))
    return F.lit(start) + (F.lit(end) - F.lit(start)) * F.least(epoch, F.lit(total - 1)) / F.lit(total - 1)


def regime_of(name: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """The regime of the first rule whose substring is in the name."""
    out = F.when(F.contains(name, F.lit(rules[0][0])), rules[0][1])
    for part, regime in rules[1:]:
        out = out.when(F.contains(name, F.lit(part)), regime)
    return out.otherwise(default)


def model_of(name: Column, prefixes: list[str], suffixes: list[str]) -> Column:
    """The name without the first of the prefixes that it has, cut before the first of the suffixes that is in it."""
    out = name
    for p in prefixes:
        out = F.when(F.startswith(out, F.lit(p)), F.substring(out, F.lit(len(p) + 1), F.length(out))).otherwise(out)
    cut = out
    for s in reversed(suffixes):
        cut = F.when(F.contains(out, F.lit(s)), F.substring_index(out, s, 1)).otherwise(cut)
    return cut


def edits(ref: Column, pred: Column) -> Column:
    return F.levenshtein(F.coalesce(ref, F.lit("")), F.coalesce(pred, F.lit("")))


def error_rate(distance: Column, ref_size: Column, pred_size: Column) -> Column:
    """0 for two empty texts, 1 for an empty reference with a prediction."""
    return F.when(ref_size == 0, F.when(pred_size == 0, 0.0).otherwise(1.0)).otherwise(distance / F.greatest(ref_size, F.lit(1)))


def cer(ref: Column, pred: Column) -> Column:
    ref, pred = F.coalesce(ref, F.lit("")), F.coalesce(pred, F.lit(""))
    return error_rate(edits(ref, pred), F.length(ref), F.length(pred))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def word_edits(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays: each distinct token becomes one code point.

    Surrogates are left out, so a pair may have a million distinct tokens.
    """
    known = F.array_distinct(F.concat(a, b))

    def sign(t: Column) -> Column:
        n = F.array_position(known, t) + 255
        return F.decode(F.unhex(F.lpad(F.hex(F.when(n < 0xD800, n).otherwise(n + 0x800)), 8, "0")), "UTF-32")

    return F.levenshtein(F.array_join(F.transform(a, sign), ""), F.array_join(F.transform(b, sign), ""))


def wer(ref: Column, pred: Column) -> Column:
    a, b = tokens(ref), tokens(pred)
    return error_rate(word_edits(a, b), F.size(a), F.size(b))
