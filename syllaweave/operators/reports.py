"""Report tables: coverage of a collection, agreement of labels, fairness, targets, samples and selections.

Every function takes and returns DataFrames; ties are always broken by a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from syllaweave.functions.text import reduced


def joined_ends(pairs: DataFrame, records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs ``(id_a, id_b, ...)`` with the columns of both records, as ``<column>_a`` and ``<column>_b``; pairs with an unknown end go."""
    side = lambda x: records.select(F.col(key).alias(f"id_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns))
    return pairs.join(side("a"), "id_a").join(side("b"), "id_b")


def dataset_statistics(e: DataFrame, splits: DataFrame) -> DataFrame:
    """``(part, versions, families, programmes, units, outcomes, tagged)`` of every split and of all."""
    tagged = F.size(F.filter("outcomes", lambda o: F.size(o["k_levels"]) > 0))
    x = e.join(splits, "family").select("split", "family", "programmes", F.greatest(F.size("units"), F.lit(0)).alias("u"), F.greatest(F.size("outcomes"), F.lit(0)).alias("o"), F.coalesce(tagged, F.lit(0)).alias("t"))
    measures = [F.count("*").alias("versions"), F.count_distinct("family").alias("families"), F.sum("u").alias("units"), F.sum("o").alias("outcomes"), F.sum("t").alias("tagged")]
    sums = x.rollup("split").agg(*measures)
    programmes = x.select("split", F.explode("programmes").alias("p")).rollup("split").agg(F.count_distinct("p").alias("programmes"))
    part = F.coalesce("split", F.lit("all")).alias("part")
    return sums.select(part, *[c for c in sums.columns if c != "split"]).join(programmes.select(part, "programmes"), "part", "left")


def default_year(snapshot: DataFrame, years: DataFrame, least: int = 10) -> DataFrame:
    """``(programme, ay)``: the newest year with ``least`` courses or more, else the newest year.

    ``snapshot`` has a row for each programme, year and family, ``years`` the distinct ``(programme, ay)``.
    """
    n = snapshot.groupBy("programme", "ay").agg(F.count("*").alias("n"))
    x = years.join(n, ["programme", "ay"], "left").withColumn("ok", F.coalesce(F.col("n") >= least, F.lit(False)))
    return x.groupBy("programme").agg(F.max_by("ay", F.struct("ok", "ay")).alias("ay"))


def percentile_rank(by: list[str], score: str, key: str) -> Column:
    """``(row_number - 1) / (n - 1)`` in the order of score and key; 0 in a group of one."""
    w = Window.partitionBy(*by)
    return (F.row_number().over(w.orderBy(score, key)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))


def quotas(df: DataFrame, stratum: str, key: str, quota: dict[str, int], seed: int = 42) -> DataFrame:
    """Up to ``quota[stratum]`` rows of each stratum in the order of a seeded hash (a sampling operator); others give none."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    most = F.lit(0)
    for s, n in quota.items():
        most = F.when(F.col(stratum) == s, F.lit(n)).otherwise(most)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def interleaved(df: DataFrame, by: str, order: list[Column], strata: int) -> DataFrame:
    """Adds ``stratum``: row numbers in ``order`` dealt to ``strata`` strata in turn, within each ``by``."""
    return df.withColumn("stratum", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) % strata)


def rank_among(by: list[str], score: str) -> Column:
    """One more than the number of better scores."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(score)))


def tie_averaged_rank(by: list[str], score: str) -> Column:
    """The rank among better scores, ties averaged."""
    return rank_among(by, score) + 0.5 * (F.count("*").over(Window.partitionBy(*by, score)) - 1)


def first_relevant(df: DataFrame, by: str, score: str, key: str, relevant: Column, depth: int = 300, none: int = 1_000_000) -> DataFrame:
    """``(by, rank)`` of the best-ranked relevant row among the first ``depth``; ``none`` where there is none."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    r = df.withColumn("_r", F.row_number().over(w))
    return r.groupBy(by).agg(F.coalesce(F.min(F.when(relevant & (F.col("_r") <= depth), F.col("_r"))), F.lit(none)).alias("rank"))


def accuracy_by_programme(items: DataFrame, programmes: DataFrame, key: str, correct: Column) -> DataFrame:
    """``(programme, n, accuracy)``: an item counts for each programme of its family; families without one are COMMON.

    ``programmes`` has ``key`` and an array ``programmes`` for each family.
    """
    p = programmes.select(key, F.explode(F.when(F.size("programmes") > 0, F.col("programmes")).otherwise(F.array(F.lit("COMMON")))).alias("programme"))
    return items.join(p, key).groupBy("programme").agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"))


def fairness(table: DataFrame, least: int) -> DataFrame:
    """One row: the groups with the lowest and highest accuracy among those with ``least`` items or more, and those left out."""
    enough = F.col("n") >= least
    low = F.min(F.when(enough, F.struct(F.round("accuracy", 9).alias("a"), "programme")))
    high = F.max(F.when(enough, F.struct(F.round("accuracy", 9).alias("a"), "programme")))
    out = table.agg(low.alias("l"), high.alias("h"), F.array_join(F.array_sort(F.collect_set(F.when(~enough, F.col("programme")))), ";").alias("excluded"))
    return out.select(F.col("l.programme").alias("lowest"), F.col("l.a").alias("low"), F.col("h.programme").alias("highest"), F.col("h.a").alias("high"), "excluded")


def against_targets(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``(metric, value, op, target, met)`` for ``targets(metric, op, target)``: met is yes, no or n/a without a value."""
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return targets.join(values, "metric", "left").select("metric", "value", "op", "target", F.when(F.col("value").isNull(), "n/a").when(ok, "yes").otherwise("no").alias("met"))


def reuse_labels(items: DataFrame, labels: DataFrame, keys: list[str], label: str, default: str) -> DataFrame:
    """Items with the label of an earlier item of equal reduced keys, else ``default``; of several labels the least counts."""
    norm = [F.coalesce(reduced(F.col(k)), F.lit("")).alias(f"_{k}") for k in keys]
    known = labels.select(*norm, label).groupBy(*[f"_{k}" for k in keys]).agg(F.min(label).alias(label))
    out = items.select("*", *norm).join(known, [f"_{k}" for k in keys], "left")
    return out.withColumn("reused", F.col(label).isNotNull()).withColumn(label, F.coalesce(label, F.lit(default))).drop(*[f"_{k}" for k in keys])


def without_leaks(df: DataFrame, text: str, split: str, order: list[str], key: str) -> DataFrame:
    """Each text once: in the first split of ``order`` that has it, there the least key."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(text).orderBy(at, key))).filter("_n = 1").drop("_n")


def worst(df: DataFrame, kind: str, score: Column, key: str, k: dict[str, int]) -> DataFrame:
    """The ``k[kind]`` rows of each kind with the largest ``score`` (a top-k report)."""
    most = F.lit(0)
    for name, n in k.items():
        most = F.when(F.col(kind) == name, F.lit(n)).otherwise(most)
    w = Window.partitionBy(kind).orderBy(score.desc(), key)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def greedy_tp(a: Column, b: Column, tau: float) -> Column:
    """Number of one-to-one matches of two arrays of phrases, the best word overlap first, if it is ``tau`` or more.

    Ties go to the larger phrases. All of it is array expressions, so a row's phrases never leave the JVM.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    sim = lambda x, y: F.size(F.array_intersect(words(x), words(y))) / F.greatest(F.lit(1), F.size(F.array_union(words(x), words(y))))
    cand = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.round(sim(x, y), 9).alias("s"), x.alias("a"), y.alias("b")))))
    cand = F.reverse(F.array_sort(F.filter(cand, lambda c: c["s"] >= tau)))
    start = F.struct(F.array().cast("array<string>").alias("a"), F.array().cast("array<string>").alias("b"))

    def step(used: Column, c: Column) -> Column:
        free = ~F.array_contains(used["a"], c["a"]) & ~F.array_contains(used["b"], c["b"])
        return F.when(free, F.struct(F.array_append(used["a"], c["a"]).alias("a"), F.array_append(used["b"], c["b"]).alias("b"))).otherwise(used)

    return F.size(F.aggregate(cand, start, step)["a"])


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact McNemar p of ``b`` against ``c`` discordant cases, by logarithms; 1 where they are equal, NULL without cases."""
    n, k = b + c, F.least(b, c)
    start = F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum"))
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    # the sum of C(n, i) over i up to k, scaled by its last term so that nothing overflows

    def step(acc: Column, i: Column) -> Column:
        more = F.log((n - i + 1).cast("double") / i)
        return F.struct((acc["log"] + more).alias("log"), (acc["sum"] * F.exp(-more) + 1).alias("sum"))

    out = F.aggregate(steps, start, step)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(out["log"] + F.log(out["sum"]) - n * F.log(F.lit(2.0)))))


def weighted_kappa(df: DataFrame, a: str, b: str, power: int) -> DataFrame:
    """One row ``(n, kappa)`` of two numeric ratings, disagreements weighted by their difference to ``power`` (1 linear, 2 quadratic)."""
    x = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
    cell = x.groupBy("a", "b").agg(F.count("*").alias("c"))
    ra, rb = cell.groupBy("a").agg(F.sum("c").alias("ca")), cell.groupBy("b").agg(F.sum("c").alias("cb"))
    w = F.pow(F.abs(F.col("a") - F.col("b")), F.lit(float(power)))
    observed = cell.agg(F.sum("c").alias("n"), F.sum(w * F.col("c")).alias("o"))
    expected = ra.crossJoin(F.broadcast(rb)).agg(F.sum(w * F.col("ca") * F.col("cb")).alias("e"))  # a row for each rating
    return observed.crossJoin(F.broadcast(expected)).select("n", F.when(F.col("e") > 0, 1 - F.col("o") * F.col("n") / F.col("e")).alias("kappa"))


def multilabel(df: DataFrame, true: str, said: str, labels: int) -> DataFrame:
    """One row of micro, macro and sample F1 and Hamming loss of label arrays; macro is over the labels that either side has."""
    x = df.select(F.array_distinct(true).alias("t"), F.array_distinct(said).alias("p"))
    tp = F.size(F.array_intersect("t", "p"))
    per = x.select(tp.alias("tp"), F.size("t").alias("nt"), F.size("p").alias("np"))
    f1 = F.when(F.col("nt") + F.col("np") > 0, 2 * F.col("tp") / (F.col("nt") + F.col("np"))).otherwise(1.0)
    whole = per.agg(F.count("*").alias("n"), (2 * F.sum("tp") / F.sum(F.col("nt") + F.col("np"))).alias("micro_f1"), F.avg(f1).alias("sample_f1"), (F.sum(F.col("nt") + F.col("np") - 2 * F.col("tp")) / (F.count("*") * labels)).alias("hamming"))
    each = x.select(F.explode(F.array_union("t", "p")).alias("l"), "t", "p")
    by = each.groupBy("l").agg((2 * F.count_if(F.array_contains("t", F.col("l")) & F.array_contains("p", F.col("l"))) / (F.count_if(F.array_contains("t", F.col("l"))) + F.count_if(F.array_contains("p", F.col("l"))))).alias("f1"))
    return whole.crossJoin(F.broadcast(by.agg(F.avg("f1").alias("macro_f1"))))


def as_percent(c: Column) -> Column:
    """A share as a whole percentage, rounded half to even."""
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


def formatted(c: Column, digits: int) -> Column:
    """A number with thousands separators and ``digits`` decimals."""
    return F.format_number(c, digits)
