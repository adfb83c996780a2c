"""Skill themes, topic clusters, drafts, summaries, perturbations and samples."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from syllaweave.functions import course as C
from syllaweave.functions.text import let, words_of

#: Words that name no skill by themselves, leading verbs and determiners of skill phrases.
GENERIC_SKILL_WORDS = (
    "experience experiences skill skills knowledge understanding background foundations foundation familiarity practice practices use cost quality "
    "rates rate release production data text model models system systems method methods technique techniques tool tools library libraries ecosystem "
    "service services team teams work way ways part parts case cases level levels range variety number lot question sequence training"
)
LEAD_VERB = (
    r"(?i)^(?:build|clean|monitor|apply|design|deploy|index|align|fine-tune|evaluate|set up|handle|compress|adapt|curate|deduplicate|filter|track|"
    r"maintain|reduce|remove|combine|improve|keep|experience|develop|create|use)\s+(?:and\s+)?"
)
DETERMINERS = r"(?i)^(?:the|a|an|this|these|their|our|its|all|any|some|such|other|strong|solid|good|deep|basic|new)\s+"
TOOLS = r"(?i)\b(?:python|pytorch|tensorflow|docker|kubernetes|gpus?|cloud|rest api|api development|hugging face|git|linux|sql)\b"
PHRASE_BREAK = r"(?i)[,;:.()/]|\b(?:and|or|with|of|for|in|on|to|using|such as|like|from|by|at|into|as|through|under|between|over|before|after|is|are|be)\b"


def skill_phrases(sentence: Column) -> Column:
    """Noun-like phrases of a requirement by rule: cut at function words, then leading determiners and verbs go.

    A phrase keeps its first spelling; it has three characters or more and a word that isn't generic.
    """
    generic = GENERIC_SKILL_WORDS.split()
    lead = rf"(?i)^(?:{DETERMINERS[5:]}|{LEAD_VERB[5:]})+"
    parts = F.transform(F.split(F.coalesce(sentence, F.lit("")), PHRASE_BREAK), lambda p: F.regexp_replace(F.regexp_replace(p, r"^[^A-Za-z]+|[\s\xA0]+$", ""), lead, ""))
    words = lambda p: F.regexp_extract_all(F.lower(p), F.lit(r"[a-z][a-z+\-]*"), F.lit(0))
    return F.filter(parts, lambda p: (F.length(p) > 2) & F.exists(words(p), lambda w: ~w.isin(generic)))


def average_linkage(vectors: np.ndarray, tau: float) -> np.ndarray:
    """Cluster of each unit vector: average linkage on cosine, merged while the similarity is ``tau`` or more.

    Every row keeps its closest partner, so a merge looks at one row and at those whose partner it takes away.
    """
    n = len(vectors)
    sim = vectors @ vectors.T
    np.fill_diagonal(sim, -np.inf)
    size, label = np.ones(n), np.arange(n)
    near = sim.argmax(1) if n else np.zeros(0, np.int64)
    best = sim[np.arange(n), near]
    while n > 1:
        i = int(best.argmax())
        if best[i] < tau:
            break
        i, j = min(i, int(near[i])), max(i, int(near[i]))
        merged = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j])
        merged[[i, j]] = -np.inf
        sim[i], sim[:, i] = merged, merged
        sim[j], sim[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        label[label == j] = i
        best[j] = -np.inf
        closer = np.flatnonzero(merged > best)
        near[closer], best[closer] = i, merged[closer]
        lost = np.flatnonzero(((near == i) | (near == j)) & (best > -np.inf) & (merged < best))
        for r in np.append(lost, i):
            near[r] = sim[r].argmax()
            best[r] = sim[r, near[r]]
    return np.unique(label, return_inverse=True)[1]


def themes(df: DataFrame, group: str, item: str, vec: str, tau: float) -> DataFrame:
    """``(group, item, cluster, medoid)``: phrases of one group clustered by meaning; ``medoid`` names the cluster.

    A group is one set of job descriptions (hundreds of phrases); groups are spread over tasks.
    """
    kind = dict(df.dtypes)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(item, kind="stable")
        v = np.stack(x[vec].to_numpy()).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-12
        lab = average_linkage(v, tau)
        items = x[item].to_numpy()
        best = {k: items[np.flatnonzero(lab == k)[int(np.argmax(v[lab == k] @ v[lab == k].mean(0)))]] for k in set(lab)}
        return pd.DataFrame({group: x[group].to_numpy(), item: items, "cluster": lab, "medoid": [best[k] for k in lab]})

    return df.select(group, item, vec).groupBy(group).applyInPandas(run, f"{group} {kind[group]}, {item} {kind[item]}, cluster int, medoid {kind[item]}")


def topic_model(df: DataFrame, key: str, vec: str, k: int = 40, starts: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Best of ``starts`` k-means runs: ``(key, topic, sim)`` and centroids ``(topic, centroid)`` of unit length."""
    x = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    n = x.count()
    models = [KMeans(k=min(k, max(2, n)), seed=seed + i, featuresCol="features", predictionCol="topic").fit(x) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    unit = [[float(a) for a in c / (np.linalg.norm(c) + 1e-12)] for c in best.clusterCenters()]  # k rows
    cents = df.sparkSession.createDataFrame(list(enumerate(unit)), "topic int, centroid array<double>")
    out = best.transform(x).select(key, "topic", vector_to_array("features").alias("v")).join(F.broadcast(cents), "topic")
    sim = F.aggregate(F.zip_with("v", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    return out.select(key, "topic", sim.alias("sim")), cents


def skill_gaps(jobs: DataFrame, units: DataFrame, tau: float = 0.55, least: int = 2) -> DataFrame:
    """``(theme, n_jobs, n_phrases, best, topic_key, kind, place)`` of the skills that ``least`` jobs or more ask for.

    ``jobs`` has ``job, text``, ``units`` ``id, title, text``. Phrases of one reduced form are one theme, named by the least
    of them. A theme is covered if a topic of a unit is as close as ``tau`` (cosine of content words), else it is a tool
    (for the lab) or a gap. Places count within each kind, the most wanted first.
    """
    from syllaweave.functions.text import reduced
    from syllaweave.operators.prerequisites import close

    p = jobs.select("job", F.explode(C.requirements(F.col("text"))).alias("r")).select("job", F.explode(skill_phrases(F.col("r"))).alias("phrase")).withColumn("k", reduced(F.col("phrase"))).filter("k <> ''")
    t = p.groupBy("k").agg(F.min("phrase").alias("theme"), F.count_distinct("job").alias("n_jobs"), F.count_distinct("phrase").alias("n_phrases")).filter(F.col("n_jobs") >= least).drop("k")
    topics = units.select(F.explode(C.unit_topics(F.col("text"))).alias("text")).distinct()
    best = close(t.select(F.col("theme").alias("phrase")), topics, tau).groupBy(F.col("phrase").alias("theme")).agg(F.max("sim").alias("best"), F.max_by("text", F.struct("sim", "text")).alias("topic_key"))
    x = t.join(best, "theme", "left")
    kind = F.when(F.col("best").isNotNull(), "covered").when(F.col("theme").rlike(TOOLS), "tool").otherwise("gap")
    x = x.withColumn("kind", kind).withColumn("best", F.coalesce("best", F.lit(0.0)))
    w = Window.partitionBy("kind").orderBy(F.desc("n_jobs"), F.desc("n_phrases"), F.lower("theme"), "theme")
    return x.withColumn("place", F.row_number().over(w))


def teaching_scheme(df: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent (lecture, practical, tutorial, credits) of each group among rows with credits; ties to the least."""
    s = F.struct("lecture_hrs", "practical_hrs", "tutorial_hrs", "credits")
    c = df.filter("credits is not null").groupBy(*by, s.alias("scheme")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), *(F.col(f"scheme.{c}").asc_nulls_first() for c in ("lecture_hrs", "practical_hrs", "tutorial_hrs", "credits")))
    return c.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, "scheme.*")


def draft(view: DataFrame, shared: DataFrame, by: str = "programme") -> DataFrame:
    """A draft syllabus of each group: units (shared first), hours, outcomes, prerequisites, scheme, as one row.

    ``view`` has the group's courses; ``shared`` has ``(group, title, text, hours, sources)`` of its units. A unit without
    hours counts six; of outcomes the first four in id order; every unit and outcome names a source.
    """
    u = shared.withColumn("hours", F.coalesce("hours", F.lit(6)))
    unit = F.struct((-F.size("sources")).alias("order"), "title", "text", "hours", "sources")
    units = u.groupBy(by).agg(F.sort_array(F.collect_list(unit)).alias("units"), F.sum("hours").alias("total_hours"))
    o = view.select(by, "id", F.posexplode("outcomes").alias("i", "o")).select(by, "id", "i", "o.text")
    first = o.groupBy(by, "text").agg(F.min(F.struct("id", "i")).alias("at"))
    w = Window.partitionBy(by).orderBy("at.id", "at.i")
    first = first.withColumn("r", F.row_number().over(w)).filter("r <= 4")
    level = C.bloom_name(F.coalesce(C.lexicon_level(F.col("text")), F.lit(3)))
    outs = first.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("r", "text", level.alias("bloom"), F.col("at.id").alias("source")))).alias("outcomes"))
    pre = view.select(by, F.explode(C.split_prerequisites(F.col("prerequisites"))).alias("p")).groupBy(by).agg(F.array_sort(F.collect_set("p")).alias("prerequisites"))
    head = view.groupBy(by).agg(F.count("*").alias("n_courses"), F.max("ay").alias("academic_year"))
    return head.join(units, by, "left").join(outs, by, "left").join(pre, by, "left").join(teaching_scheme(view, [by]), by, "left")


def markdown(title: Column) -> Column:
    """A draft row of :func:`draft` as Markdown, headings in a fixed order."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    units = F.transform(F.coalesce("units", F.array()), lambda u, i: F.concat((i + 1).cast("string"), F.lit(". **"), u["title"], F.lit("** ("), u["hours"].cast("string"), F.lit(" h) - "), u["text"], F.lit("\n   *Source: "), F.array_join(u["sources"], "; "), F.lit("*")))
    outs = F.transform(F.coalesce("outcomes", F.array()), lambda o: F.concat(F.lit("- "), o["text"], F.lit(" ("), o["bloom"], F.lit("; source "), o["source"], F.lit(")")))
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), title), F.concat(F.lit("Academic year: "), "academic_year", F.lit(" | Credits: "), number("credits")),
        F.concat(F.lit("**Prerequisites:** "), F.coalesce(F.nullif(F.array_join("prerequisites", ", "), F.lit("")), F.lit("none listed"))),
        F.lit("## Units"), F.array_join(units, "\n"), F.lit("## Learning outcomes"), F.array_join(outs, "\n"),
    )


def traceable() -> Column:
    """Every unit and outcome of a draft names a source."""
    return F.forall(F.coalesce("units", F.array()), lambda u: F.size(u["sources"]) > 0) & F.forall(F.coalesce("outcomes", F.array()), lambda o: F.length(o["source"]) > 0)


def lead_summary(n: int = 3) -> Column:
    """The first ``n`` unit titles of a course as one line."""
    return F.array_join(F.slice(F.filter(F.transform("units", lambda u: u["title"]), lambda t: F.coalesce(t, F.lit("")) != ""), 1, n), "; ")


def outcome_summary(n: int = 2) -> Column:
    return F.array_join(F.slice(F.transform("outcomes", lambda o: o["text"]), 1, n), " ")


def rouge_n(reference: Column, candidate: Column, n: int) -> dict[str, Column]:
    """Precision, recall and F1 of clipped n-gram overlap, unstemmed; zero without n-grams."""
    def grams(c: Column) -> Column:
        w = words_of(c)
        return w if n == 1 else F.transform(F.filter(F.arrays_zip(w.alias("a"), F.slice(w, 2, 1 << 30).alias("b")), lambda p: p["b"].isNotNull()), lambda p: F.concat_ws(" ", p["a"], p["b"]))

    r, c = grams(reference), grams(candidate)
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    hits = F.aggregate(F.array_distinct(c), F.lit(0), lambda s, w: s + F.least(count(c, w), count(r, w)))
    p, q = hits / F.greatest(F.size(c), F.lit(1)), hits / F.greatest(F.size(r), F.lit(1))
    return {"precision": p, "recall": q, "f1": F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)}


@F.pandas_udf(DoubleType())
def rouge_l(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """F1 of the longest common word subsequence."""

    def f1(a: str | None, b: str | None) -> float:
        x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (a, b))
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        return 2 * row[-1] / (len(x) + len(y)) if x and y else 0.0

    return pd.Series([f1(a, b) for a, b in zip(reference, candidate)], dtype="float64")


def unsupported_rate(summary: Column, source: Column) -> Column:
    """Share of a summary's distinct words (four letters or more) that its source lacks."""
    w = F.array_distinct(F.filter(words_of(summary), lambda x: F.length(x) >= 4))
    return F.size(F.array_except(w, words_of(source))) / F.greatest(F.size(w), F.lit(1))


def supported(summary: Column, source: Column, most: float = 0.2) -> Column:
    """A summary with text, at most the share ``most`` of words that its source lacks, and only percentages that the source names."""
    percents = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+(?:\.\d+)?\s?%"), F.lit(0))
    return (unsupported_rate(summary, source) <= most) & (F.coalesce(summary, F.lit("")) != "") & (F.size(F.array_except(percents(summary), percents(source))) == 0)


def central(df: DataFrame, key: str, pos: str, text: str, n: int) -> DataFrame:
    """``(key, summary)``: the ``n`` texts of each key closest to their mean vector (hashed terms), in their order.

    Texts without terms aren't chosen; a key without any gives no row. Ties go to the earlier text.
    """
    from syllaweave.operators.lexical import counts, hashed_vectors

    x = df.withColumn("_u", F.struct(key, pos))
    v = hashed_vectors(counts(x, ["_u"], F.col(text)), "_u").select(F.col(f"_u.{key}").alias(key), F.col(f"_u.{pos}").alias(pos), "dim", "v")
    size = v.groupBy(key).agg(F.count_distinct(pos).alias("_n"))
    mean = v.join(size, key).groupBy(key, "dim").agg((F.sum("v") / F.max("_n")).alias("m"))
    s = v.join(mean, [key, "dim"]).groupBy(key, pos).agg(F.round(F.sum(F.col("v") * F.col("m")), 9).alias("s"))
    w = Window.partitionBy(key).orderBy(F.desc("s"), pos)
    top = s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select(key, pos).join(df.select(key, pos, text), [key, pos])
    return top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda t: t[text]), " ").alias("summary"))


def perturb(text: Column, kind: str, rate: float, seed: int) -> Column:
    """A seeded change of a text: ``typos`` (neighbours swapped), ``drop`` (words left out) or ``truncate`` (the first part kept).

    Whether a word is changed, and where, is decided by a hash of the seed, its place and the word, so the same text
    changes alike everywhere. A text keeps its first word at least; NULL counts as empty.
    """
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    share = lambda w, i, part: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), w)), part, 6), 16, 10).cast("double") / float(16**6)

    def swapped(w: Column, i: Column) -> Column:
        k = (F.floor(share(w, i, 7) * (F.length(w) - 3)) + 2).cast("int")
        mixed = F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1, F.lit(1)), F.substr(w, k, F.lit(1)), F.substr(w, k + 2))
        return F.when((F.length(w) > 3) & (share(w, i, 1) < rate), mixed).otherwise(w)

    if kind == "truncate":
        return F.array_join(let(words, lambda x: F.slice(x, 1, F.greatest(F.lit(1), F.floor(F.size(x) * F.lit(rate)).cast("int")))), " ")
    if kind == "drop":
        kept = lambda x: F.filter(x, lambda w, i: share(w, i, 1) >= rate)
        return F.array_join(let(words, lambda x: F.when(F.size(kept(x)) > 0, kept(x)).otherwise(F.slice(x, 1, 1))), " ")
    if kind == "typos":
        return F.array_join(F.transform(words, swapped), " ")
    raise ValueError(f"unknown kind {kind!r}")


def stratified(df: DataFrame, stratum: str, key: str, quota: int, seed: int = 42) -> DataFrame:
    """Up to ``quota`` rows of each stratum in the order of a seeded hash of the key (a sampling operator)."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= quota).drop("_n")
