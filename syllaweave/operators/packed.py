"""Several values packed in one field: one row for each value, with its position.

The field is split on quote characters: odd pieces are literals, even pieces are text. A first array fold puts the
pieces back into a skeleton in which each literal is one private-use mark (doubled quotes inside a literal stand for a
quote); the skeleton is split on delimiters, and a second fold reassembles values, ordinals and numbered parts. All of
it is built-in SQL, so a plan has no Python stage and one exchange (the removal of rows delivered twice).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from syllaweave.functions.text import NONE_WORDS, let, reduced
from syllaweave.session import bounded_rows

#: Private-use characters: value border, literal, protected joining word.
SEP, LIT, AND = "\ue000", "\ue001", "\ue002"
#: Words that join two values, besides ``&``.
JOINING = ["and/or", "and / or", "as well as", "along with", "and", "or", "plus"]
DELIMITERS = ",;|/\\n\\r\\t+，；、"
BULLETS = "•▪·◦‣●*"
ROMAN = "(?:[IVX]+)"
#: Most protected names that are put into the pattern; the list is checked before it leaves the cluster.
NAMES_IN_PATTERN = 5_000


def name_pattern(names: list[str]) -> str | None:
    """A pattern for the joining word (``and`` or ``&``) inside one of ``names``, in any case and spacing."""
    by_right: dict[str, set[str]] = {}

    def part(text: str) -> str:
        return r"\s{1,9}".join(re.escape(w) for w in text.split())

    for n in names:
        for m in re.finditer(r"(?i)\s(?:and|&)\s", n or ""):
            by_right.setdefault(part(n[m.end():].replace("&", "and")), set()).add(part(n[: m.start()].replace("&", "and")))
    if not by_right:
        return None
    sides = [rf"(?<=(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(left))})\s{{1,9}}(?:and|&))(?=\s{{1,9}}{right}(?![\p{{L}}\p{{N}}]))" for right, left in sorted(by_right.items())]
    return rf"(?i)(?:and|&)(?:{'|'.join(sides)})"


def packed_values(c: Column, names: list[str] = ()) -> Column:
    """``ARRAY<STRUCT<value, quoted>>`` of a packed field, in written order.

    NULL, empty and "there is none" fields give an empty array; a quote that is never closed counts as a plain
    character; a value named twice stays twice; ``names`` are the names whose joining words don't divide.
    """
    # curly quotes and paired single quotes become one kind of quote
    s = F.translate(F.coalesce(c, F.lit("")), "“”„«»", '"' * 5)
    s = F.regexp_replace(s, r"(?<![\p{L}\p{N}'])'([^'\"]*(?:''[^'\"]*)*)'(?![\p{L}\p{N}'])", '"$1"')
    indexed = let(F.split(s, '"', -1), lambda pieces: F.transform(pieces, lambda t, i: F.struct(t.alias("t"), i.alias("i"), F.size(pieces).alias("n"))))
    start = F.struct(F.lit("").alias("skel"), F.array().cast("array<string>").alias("lits"), F.lit(None).cast("string").alias("open"))

    def fold(acc: Column, p: Column) -> Column:
        literal = (p["i"] % 2 == 1) & (p["i"] < p["n"] - 1)
        doubled = (p["t"] == "") & (p["i"] > 0) & (p["i"] < p["n"] - 2) & acc["open"].isNotNull()
        was_open = acc["open"].isNotNull()
        return F.when(literal, F.struct(acc["skel"].alias("skel"), acc["lits"].alias("lits"), F.concat(F.coalesce(acc["open"], F.lit("")), p["t"]).alias("open"))).when(
            doubled, F.struct(acc["skel"].alias("skel"), acc["lits"].alias("lits"), F.concat(acc["open"], F.lit('"')).alias("open"))
        ).otherwise(
            F.struct(
                F.concat(acc["skel"], F.when(was_open, F.lit(SEP + LIT + SEP)).otherwise(F.lit("")), p["t"]).alias("skel"),
                F.when(was_open, F.concat(acc["lits"], F.array(acc["open"]))).otherwise(acc["lits"]).alias("lits"),
                F.lit(None).cast("string").alias("open"),
            )
        )

    folded = F.aggregate(indexed, start, fold)
    return F.when(reduced(F.coalesce(c, F.lit(""))).isin("", *NONE_WORDS), F.array().cast("array<struct<value:string,quoted:boolean>>")).otherwise(let(folded, lambda x: _values(x, names)))


def _values(folded: Column, names: list[str]) -> Column:
    skel = folded["skel"]
    for _ in range(2):  # remarks, and remarks within remarks
        skel = F.regexp_replace(skel, r"\([^()]*\)", " ")
    if pattern := name_pattern(list(names)):
        skel = F.regexp_replace(skel, pattern, AND)
    joining = "|".join(re.sub(r"\\? ", r"\\s+", re.escape(w)) for w in JOINING)
    skel = F.regexp_replace(skel, rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{joining})(?![\p{{L}}\p{{N}}])|&", SEP)
    skel = F.regexp_replace(skel, f"[{DELIMITERS}{BULLETS}]", SEP)
    number = rf"\d{{1,2}}[.)](?=\s*[^\s\d{SEP}]|\s*{SEP}{LIT})"
    skel = F.when(skel.rlike(r"^\s*\d{1,2}[.)]"), F.regexp_replace(skel, rf"(?:^|(?<=[\s{SEP}])){number}", SEP)).otherwise(F.regexp_replace(skel, rf"(?:^|(?<={SEP}))(\s*){number}", SEP))
    parts = F.transform(F.split(skel, SEP), lambda v: F.regexp_replace(F.replace(v, F.lit(AND), F.lit("and")), r"^[\s\-–—.:]+|[\s\-–—:]+$", ""))
    parts = F.filter(parts, lambda v: v != "")
    kind = "struct<value:string,quoted:boolean>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0).alias("li"), F.lit(None).cast("string").alias("base"))
    numbered = rf"(?i)^(.*[^\s\-–—])[\s\-–—]*(?<![\p{{L}}\p{{N}}])(?:{ROMAN}|\d)[.\s]*$"

    def fold(acc: Column, v: Column) -> Column:
        quoted = v == LIT
        bare = v.rlike(rf"(?i)^{ROMAN}[.\s]*$") & acc["base"].isNotNull()
        value = F.when(quoted, F.get(folded["lits"], acc["li"])).when(bare, F.concat(acc["base"], F.lit(" "), v)).otherwise(v)
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(value.alias("value"), quoted.alias("quoted")))).alias("out"),
            (acc["li"] + quoted.cast("int")).alias("li"),
            F.when(bare, acc["base"]).otherwise(F.nullif(F.regexp_extract(value, numbered, 1), F.lit(""))).alias("base"),
        )

    return F.filter(F.aggregate(parts, start, fold)["out"], lambda x: reduced(x["value"]) != "")


def split_packed(df: DataFrame, text: str, key: str, names: DataFrame | None = None) -> DataFrame:
    """One row ``(key, pos, value, quoted, value_key)`` for each value of ``df[text]``.

    Rows delivered twice unchanged count once; a NULL key is kept as a key; empty tables give no rows; other columns of
    ``df`` are not read. ``names`` (one string column) are names whose joining words don't divide. The list is put into
    the pattern only up to a checked bound.
    """
    listed: list[str] = []
    if names is not None:
        col = F.col(names.columns[0])
        joined = names.filter(col.rlike(r"(?i)\s(?:and|&)\s")).select(col).distinct()
        rows = bounded_rows(joined, NAMES_IN_PATTERN)
        if rows is None:
            raise ValueError(f"more than {NAMES_IN_PATTERN} names hold a joining word; pass them in parts")
        listed = [r[0] for r in rows]
    rows = df.select(F.col(key), F.col(text).alias("_packed")).filter(F.trim("_packed") != "").distinct()
    out = rows.select(key, F.posexplode(packed_values(F.col("_packed"), listed)).alias("_p", "_v"))
    return out.select(key, (F.col("_p") + 1).cast("bigint").alias("pos"), F.col("_v.value").alias("value"), F.col("_v.quoted").alias("quoted"), reduced(F.col("_v.value")).alias("value_key")).distinct()
