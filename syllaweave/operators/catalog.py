"""Course versions to families, programmes, schedules and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions import course as C, rules
from syllaweave.operators.graph import components


def versions(df: DataFrame) -> DataFrame:
    """One row for each version id (rows delivered twice count once); rows without an id are dropped."""
    return df.filter(F.col("id").isNotNull()).dropDuplicates(["id"])


def enrich(df: DataFrame, family: Column | None = None) -> DataFrame:
    """Adds ``family, common, open_elective, programmes, study_year, sem, ay`` to course versions.

    ``family`` defaults to the name key, else the id; use :func:`families` for the closure over names and codes.
    Missing or empty paths give no programme; pools are flags, not programmes.
    """
    parts = F.transform(F.coalesce("source_files", F.array().cast("array<string>")), lambda s: F.split(s, "/"))
    progs = F.array_distinct(F.transform(parts, lambda p: F.when(F.size(p) > 2, C.programme_of(F.get(p, F.lit(1)))).otherwise(F.lit("OTHER"))))
    years = F.transform(parts, lambda p: F.nullif(F.regexp_extract(F.get(p, F.lit(0)), r"^(\d)", 1), F.lit("")).cast("int"))
    out = df.withColumns({
        "family": family if family is not None else F.coalesce(C.name_key(F.col("course_key"), F.col("course_name")), F.col("id")),
        "_p": progs,
        "study_year": F.array_min(F.filter(years, lambda y: y > 0)),
        "ay": F.coalesce(C.year_key(F.col("academic_year")), F.lit("")),
    })
    return out.withColumns({
        "common": F.array_contains("_p", "COMMON") | F.lower(F.coalesce("program", F.lit(""))).rlike(rules.ALL_PROGRAMMES),
        "open_elective": F.array_contains("_p", "OPEN"),
        "programmes": F.array_sort(F.array_except("_p", F.array(*map(F.lit, rules.POOLS)))),
        "sem": F.coalesce(C.sem_min(F.col("semester")), 2 * F.col("study_year") - 1),
    }).drop("_p")


def families(df: DataFrame) -> DataFrame:
    """``(id, family)``: same name key or same code, directly or over others; named after the least id of the family."""
    v = df.select("id", C.name_key(F.col("course_key"), F.col("course_name")).alias("name"), C.code_key(F.col("code")).alias("code"))
    nodes = v.select("id", F.concat(F.lit("n:"), "name").alias("name"), F.concat(F.lit("c:"), "code").alias("code"))
    roots = components(nodes.select("name", "code"), "name", "code")
    own = nodes.withColumn("node", F.coalesce("name", "code", F.concat(F.lit("i:"), "id"))).join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("id").alias("first"))
    return own.join(least, "root").select("id", F.concat(F.lit("f"), F.substring("first", 3, 1 << 20)).alias("family"))


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def representatives(e: DataFrame) -> DataFrame:
    """One version for each family: the latest year, then the most files, then the largest id."""
    return _first(e, ["family"], [F.desc("ay"), F.desc("n_source_files"), F.desc("id")])


def programme_list(e: DataFrame) -> DataFrame:
    return e.select(F.explode("programmes").alias("programme")).distinct()


def by_programme(e: DataFrame) -> DataFrame:
    """A row for each version and programme; a common course counts for every programme.

    The list of programmes has as many rows as there are rules (a fixed few), so its broadcast is bounded.
    """
    every = e.filter("common").crossJoin(F.broadcast(programme_list(e)))
    own = e.filter("not common").withColumn("programme", F.explode("programmes"))
    return every.unionByName(own.select(*every.columns))


def programme_view(e: DataFrame) -> DataFrame:
    """The latest version of each family in each programme."""
    return _first(by_programme(e), ["programme", "family"], [F.desc("ay"), F.desc("id")])


def structure(e: DataFrame) -> DataFrame:
    """Distinct ``(programme, sem, family)``; versions without a semester are left out."""
    return by_programme(e.select("programmes", "common", "sem", "family")).filter("sem is not null").select("programme", "sem", "family").distinct()


def version_counts(e: DataFrame) -> DataFrame:
    """Versions of each programme; common courses aren't spread over programmes here."""
    return e.select(F.explode("programmes").alias("programme")).groupBy("programme").agg(F.count("*").alias("n"))


def snapshot(e: DataFrame) -> DataFrame:
    """The courses of each programme in each academic year: of a family's versions the one with the largest id."""
    x = e.filter("ay <> ''").withColumn("programme", F.explode("programmes"))
    return _first(x, ["programme", "ay", "family"], [F.desc("id")])


def year_pairs(e: DataFrame, least: int = 10) -> DataFrame:
    """``(programme, ay, next_ay)``: adjacent years (of all years) with ``least`` courses or more in both."""
    sizes = snapshot(e.select("id", "ay", "family", "programmes")).groupBy("programme", "ay").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    years = e.filter("ay <> ''").select("ay").distinct()  # a few years
    years = years.withColumn("next_ay", F.lead("ay").over(Window.partitionBy(F.lit(0)).orderBy("ay")))
    a, b = sizes.alias("a"), sizes.alias("b")
    return a.join(F.broadcast(years), "ay").join(b, (F.col("a.programme") == F.col("b.programme")) & (F.col("next_ay") == F.col("b.ay"))).select(F.col("a.programme").alias("programme"), F.col("a.ay").alias("ay"), "next_ay", F.col("a.n").alias("n"), F.col("b.n").alias("next_n"))


def search(e: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """Courses whose name holds ``q``, newest first; the limit (1 to 500) is the feature."""
    hit = e.filter(F.contains(F.lower("course_name"), F.lit(q.lower())))
    return hit.orderBy(F.desc("ay"), F.desc("id")).limit(max(1, min(limit, 500)))


CONTENT = ("course_key", "code", "academic_year", "program", "semester", "units", "objectives")


def content_hash(df: DataFrame, columns: tuple[str, ...] = CONTENT) -> DataFrame:
    """Exact copies of content: one row for each hash with its first source and id, its content id and all its sources.

    NULL and the empty string are different content; of nested units only the texts count.
    """
    parts = [F.col("units.text").alias("units") if c == "units" else F.col(c) for c in columns]
    x = df.withColumn("hash", F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})))
    first = F.min(F.struct("source", "id"))
    out = x.groupBy("hash").agg(F.count("*").alias("n_blocks"), first.alias("_f"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.select("hash", "n_blocks", F.col("_f.id").alias("kept_id"), F.concat(F.lit("nm"), F.substring("hash", 1, 8)).alias("content_id"), "sources")


def statistics(v: DataFrame) -> DataFrame:
    """One row of counts over course versions, in one aggregation."""
    n = lambda c: F.count_if(c)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return v.agg(
        F.count("*").alias("courses"),
        F.count_distinct("course_key").alias("names"),
        n(text("prerequisites")).alias("with_prerequisites"),
        n(text("objectives")).alias("with_objectives"),
        n(F.size("outcomes") > 0).alias("with_outcomes"),
        F.sum(F.greatest(F.size("outcomes"), F.lit(0))).alias("outcomes_total"),
        F.sum(F.size(F.filter("outcomes", lambda o: F.size(o["k_levels"]) > 0))).alias("outcomes_with_level"),
        F.sum(F.greatest(F.size("units"), F.lit(0))).alias("units_total"),
        F.sum(F.size(F.filter("units", lambda u: F.coalesce(u["title"], F.lit("")) != ""))).alias("units_with_title"),
        F.sum(F.size(F.filter("units", lambda u: u["hours"].isNotNull()))).alias("units_with_hours"),
        n(text("code")).alias("with_code"),
        n(F.col("credits").isNotNull()).alias("with_credits"),
    )


def split_by_rank(families_df: DataFrame, shares: dict[str, float] = rules.SPLIT_SHARES) -> DataFrame:
    """``(family, split)``: whole families, by the rank of a hash of their name, cut at the cumulated shares."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), "family")), 1, 13), 16, 10).cast("double") / float(16**13)
    out, edge = F.lit(list(shares)[-1]), 1.0
    for s, p in reversed(list(shares.items())):
        edge -= p
        out = F.when(h < edge + p, F.lit(s)).otherwise(out)
    return families_df.select("family").distinct().withColumn("split", out)
