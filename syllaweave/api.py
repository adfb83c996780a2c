"""The engine's nine answers over a table of course versions: thin, each one a composition of operators.

Every method returns a DataFrame; ``answer`` turns a small one into JSON-ready rows at the edge. Semantic similarity is
a parameter: ``encode`` maps a DataFrame ``(key, text)`` to ``(key, vec)``, by default hashed terms (no model is shipped).
Course references are DataFrames of one row: an id, the latest version of a name, or a free text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from syllaweave.functions import course as C
from syllaweave.functions.text import reduced
from syllaweave.operators import assemble as A, catalog as K, diff as D, overlap as O, parse, prerequisites as P, reports as R, retrieval as T, vectors as V
from syllaweave.session import written

DRAFT_STATUS = "DRAFT: requires review before adoption"


class Engine:
    """Answers over ``courses`` (the columns of a course record)."""

    def __init__(self, courses: DataFrame, tau: float = O.UNIT_MATCH, least_versions: int = 50, least_families: int = 3, least_courses: int = 10, encode: Callable[[DataFrame], DataFrame] = O.hashed_encoder) -> None:
        self.tau, self.least, self.least_courses, self.encode = tau, (least_versions, least_families), least_courses, encode
        self.courses = K.enrich(K.versions(courses))

    @cached_property
    def structure(self) -> DataFrame:
        return K.structure(self.courses)

    @cached_property
    def view(self) -> DataFrame:
        return K.programme_view(self.courses)

    @staticmethod
    def answer(df: DataFrame, most: int = 500) -> list[dict]:
        """Up to ``most`` rows as dictionaries (the page size of an answer)."""
        return [r.asDict(recursive=True) for r in df.limit(most).collect()]

    def health(self) -> DataFrame:
        return self.courses.agg(F.count("*").alias("courses"), F.count_distinct("family").alias("families"))

    def list_courses(self, q: str = "", ids: list[str] | None = None, programme: str | None = None, limit: int = 50) -> DataFrame:
        """Newest first; ``ids`` override ``q``."""
        x = self.courses if programme is None else self.courses.filter(F.array_contains("programmes", programme))
        return x.filter(F.col("id").isin(ids)).orderBy(F.desc("ay"), F.desc("id")) if ids else K.search(x, q, limit)

    @cached_property
    def training(self) -> DataFrame:
        """Ids of the courses of training families: what document frequencies are counted on."""
        return self.courses.join(K.split_by_rank(self.courses).filter("split = 'train'"), "family", "left_semi").select("id")

    @cached_property
    def reference(self) -> DataFrame:
        """Scores of consecutive versions of validation families: what the fusion places a score among (a stage table)."""
        val = self.courses.join(K.split_by_rank(self.courses).filter("split = 'val'"), "family", "left_semi")
        p = val.select(F.col("id").alias("id_a"), F.lead("id").over(Window.partitionBy("family").orderBy("ay", "id")).alias("id_b")).filter("id_b is not null")
        return written(self.features(p, self.courses), "reference").select("tfidf", "soft")

    def known(self, programme: str) -> str:
        """``programme``, or an error that names the known ones."""
        have = sorted(r[0] for r in K.programme_list(self.courses).collect())  # as many as there are rules
        if programme not in have:
            raise ValueError(f"unknown programme {programme!r}; known: {', '.join(have)}")
        return programme

    def resolve(self, id: str | None = None, name: str | None = None, text: str | None = None, programme: str | None = None, ay: str | None = None) -> DataFrame:  # noqa: A002
        """The course of an id, the latest of a name (in a programme and year), or one read from a text; exactly one of the three."""
        if sum(x is not None for x in (id, name, text)) != 1:
            raise ValueError("give exactly one of id, name and text")
        if id is not None:
            return self.courses.filter(F.col("id") == id)
        if name is not None:
            hit = self.courses.filter(reduced(F.col("course_name")) == reduced(F.lit(name)))
            hit = hit if programme is None else hit.filter(F.array_contains("programmes", programme))
            hit = hit if ay is None else hit.filter(F.col("ay") == ay)
            return hit.orderBy(F.desc("ay"), F.desc("n_source_files"), F.desc("id")).limit(1)
        raw = self.courses.sparkSession.createDataFrame([(text,)], "text string").withColumn("key", F.concat(F.lit("tx"), F.substring(F.sha1("text"), 1, 8)))
        r = parse.from_text(raw, "key", "text").withColumn("id", F.col("key")).drop("key")
        r = r.withColumns({"source_files": F.array().cast("array<string>"), "n_source_files": F.lit(0)})
        own = F.array(F.lit(programme)) if programme else F.array().cast("array<string>")
        return K.enrich(r, F.col("id")).withColumn("programmes", own).select(*[c for c in self.courses.columns])

    def features(self, pairs: DataFrame, courses: DataFrame) -> DataFrame:
        return O.features(pairs, courses, self.training, O.unit_vectors(courses, self.encode), self.tau)

    def compare_courses(self, a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
        """One row: overlap in percent, similarities, confidence, warning, topics of both and of one side, prerequisite flags, outcome levels."""
        both = a.unionByName(b).dropDuplicates(["id"])
        pairs = a.select(F.col("id").alias("id_a")).join(b.select(F.col("id").alias("id_b")))  # one row
        t = O.pair_topics(pairs, O.unit_vectors(both, self.encode), self.tau, k)
        item = F.struct("place", "topic", "match", F.round("similarity", 3).alias("similarity"))
        topics = t.groupBy("id_a", "id_b").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == n, item))).alias(c) for n, c in (("common", "common_topics"), ("only a", "unique_to_a"), ("only b", "unique_to_b"))))
        f = self.features(pairs, self.courses.unionByName(both).dropDuplicates(["id"]))
        out = f.join(topics, ["id_a", "id_b"], "left").select("id_a", "id_b", O.percent(F.col("overlap")).alias("percent"), F.round("soft", 3).alias("semantic_similarity"), F.round("tfidf", 3).alias("lexical_similarity"), F.round("confidence", 3).alias("confidence"), (F.col("soft") >= O.SUBSTANTIAL).alias("redundancy_warning"), "common_topics", "unique_to_a", "unique_to_b")
        for side, x in (("a", a), ("b", b)):
            level = lambda o: C.bloom_name(F.coalesce(C.lexicon_level(o["text"]), F.lit(3)))
            outcomes = x.select(F.col("id").alias(f"id_{side}"), F.transform("outcomes", lambda o: F.struct(o["text"].alias("outcome"), level(o).alias("level"), o["k_levels"].alias("tags"))).alias(f"outcomes_{side}"))  # noqa: B023
            flags = self.check_prerequisites().join(x.select("family"), "family", "left_semi").agg(F.collect_list(F.struct("programme", "phrase", "type")).alias(f"prerequisites_{side}"))
            out = out.join(outcomes, f"id_{side}", "left").crossJoin(flags)
        return out

    def _year(self, programme: str, ay: str | None) -> str | None:
        if ay is not None:
            return ay
        s = K.snapshot(self.courses).filter(F.col("programme") == programme)
        row = R.default_year(s, s.select("programme", "ay").distinct(), self.least_courses).first()
        return row.ay if row else None

    def compare_programmes(self, programme: str, ay: str | None = None, next_ay: str | None = None, least: float = O.SUBSTANTIAL) -> DataFrame:
        """Courses retained, renamed or revised, removed and added between two years; without a year the newest full one.

        Unmatched names are matched one to one by their units' similarity, the best first, at ``least`` or above.
        """
        years = self._year(self.known(programme), ay), self._year(programme, next_ay)
        spark = self.courses.sparkSession
        pairs = spark.createDataFrame([(programme, *years)], "programme string, ay string, next_ay string")
        snap = K.snapshot(self.courses)
        change = D.by_name(snap, pairs)
        ids = snap.filter(F.col("programme") == programme).select("ay", "family", "id")
        open_ = lambda c, y: change.filter(F.col("change") == c).select(F.coalesce("family_a", "family_b").alias("family")).join(ids.filter(F.col("ay") == y), "family").select("family", "id")
        a, b = open_("removed", years[0]).toDF("a", "id_a"), open_("added", years[1]).toDF("b", "id_b")
        cand = a.join(b)  # the unmatched courses of one programme in two years
        s = O.pair_scores(cand, O.unit_vectors(self.courses, self.encode), self.tau).join(cand, ["id_a", "id_b"]).filter(F.col("soft") >= least)
        m = D.greedy_match(s.select(F.lit(programme).alias("programme"), "a", "b", F.col("soft").alias("s")), ["programme"], "programme string, a string, b string, s double")
        left = change.join(m.select(F.col("a").alias("family_a"), F.col("b").alias("new")), "family_a", "left").join(m.select(F.col("b").alias("family_b"), F.col("a").alias("old")), "family_b", "left")
        kind = F.when(F.col("new").isNotNull(), "renamed or revised").otherwise(F.col("change"))
        return left.filter("not (change = 'added' and old is not null)").select("programme", F.lit(years[0]).alias("ay"), F.lit(years[1]).alias("next_ay"), "name_key", "family_a", F.coalesce("family_b", "new").alias("family_b"), kind.alias("change"))

    def map_outcomes(self, outcomes: DataFrame, text: str = "text") -> DataFrame:
        """Bloom level of statements; the third level where no verb is listed."""
        level = F.coalesce(C.lexicon_level(F.col(text)), F.lit(3))
        return outcomes.select(text, level.alias("level"), C.bloom_name(level).alias("bloom"))

    def find_overlaps(self, course: DataFrame, k: int = 5, programme: str | None = None) -> DataFrame:
        """The representatives of other families that overlap most: fused place of both similarities, then confidence, then id."""
        reps = K.representatives(self.courses)
        reps = reps if programme is None else reps.filter(F.array_contains("programmes", self.known(programme)))
        one = course.limit(1)
        pairs = reps.select(F.col("id").alias("id_b"), "family").join(F.broadcast(one.select(F.col("id").alias("id_a"), F.col("family").alias("own"))), F.col("family") != F.col("own")).select("id_a", "id_b")  # one query row
        x = O.fused(written(self.features(pairs, self.courses.unionByName(one).dropDuplicates(["id"])), "scores"), self.reference)
        hits = O.best_hits(x, k).join(self.courses.select(F.col("id").alias("id_b"), "course_name", "ay"), "id_b")
        return hits.orderBy("place").select(F.col("id_b").alias("id"), "course_name", "ay", F.round("fusion", 3).alias("score"), F.round("confidence", 3).alias("confidence"))

    def check_prerequisites(self, programme: str | None = None, rules: int = 2) -> DataFrame:
        """Flags of the first or the second rule set."""
        covered = P.coverage(self.structure, K.version_counts(self.courses), *self.least)
        view = P.checkable(self.view if programme is None else self.view.filter(F.col("programme") == self.known(programme)), covered)
        names, first = P.exact_names(self.courses), P.earlier(self.structure)
        if rules == 1:
            return P.flags(P.phrases(view, C.split_prerequisites(F.col("prerequisites"))), names, first)
        topics = lambda df: df.withColumn("texts", P.topics(F.col("units")))
        own = topics(view).select("programme", "family", F.explode("texts").alias("text")).distinct()
        taught = topics(K.representatives(self.courses)).select("family", F.explode("texts").alias("text")).distinct()
        return P.flags_v2(P.phrases(view, C.split_prerequisites_v2(F.col("prerequisites"))), names, first, self.courses, own, taught)

    def check_status(self, programme: str | None = None) -> DataFrame:
        """Whether each course of a programme can be checked, and why not."""
        view = self.view if programme is None else self.view.filter(F.col("programme") == self.known(programme))
        return P.check_status(view, P.coverage(self.structure, K.version_counts(self.courses), *self.least)).select("programme", "family", "course_name", "sem", "status")

    def detect_redundancy(self, programme: str, k: int = 20, ay: str | None = None, least: float = O.DUPLICATE) -> DataFrame:
        """The unit pairs of different families of a programme (or of a year of it) that are most similar, one for each pair of courses."""
        x = self.view.filter((F.col("programme") == self.known(programme)) & ~F.col("common")) if ay is None else K.snapshot(self.courses).filter((F.col("programme") == programme) & (F.col("ay") == ay))
        u = O.unit_vectors(x, self.encode).filter("size(vec) > 0").join(x.select("id", "family", "course_name"), "id")
        u = u.select("id", "course_name", "label", "vec", F.xxhash64("family").alias("owner"), F.xxhash64("id", "ix").alias("unit"), F.lit(0).cast("bigint").alias("g"))
        pairs = V.unit_pairs(u, "g", "owner", "unit", "vec", least)
        best = V.best_unit_pairs(pairs, k)
        side = lambda s: u.select(F.col("unit").alias(f"ix_{s}"), F.col("id").alias(f"id_{s}"), F.col("course_name").alias(f"course_{s}"), F.col("label").alias(f"unit_{s}"))
        return best.join(side("a"), "ix_a").join(side("b"), "ix_b").select("id_a", "course_a", "unit_a", "id_b", "course_b", "unit_b", F.round("sim", 3).alias("similarity")).orderBy(F.desc("similarity"), "id_a", "id_b")

    def emerging_topics(self, topics: DataFrame, programme: str | None = None, k: int = 5, least: float = 0.3) -> DataFrame:
        """Verified topics of a reference list: covered by a unit of a programme or not, with the closest units."""
        view = self.view if programme is None else self.view.filter(F.col("programme") == self.known(programme))
        t = topics.filter("verified").select("topic", "description", "programmes")
        t = t if programme is None else t.filter(F.array_contains("programmes", programme)).withColumn("programmes", F.array(F.lit(programme)))
        return T.topic_coverage(t, view.select("programme", "id", F.posexplode("units.text").alias("i", "text")), least, k)

    def modernize(self, ids: list[str], jobs: DataFrame | None = None, title: str = "Draft", min_jobs: int = 2, max_new: int = 4) -> DataFrame:
        """One draft of two to ten courses: units they share, their units that jobs ask for, and new units for gaps.

        ``jobs`` (one to ten) has ``job, text``. Skills of ``min_jobs`` or more count; tools go to the lab; at most
        ``max_new`` gaps become units. Without jobs the draft holds the courses' units. Every unit names its sources.
        """
        if not 2 <= len(ids) <= 10:
            raise ValueError("give two to ten courses")
        x = self.courses.filter(F.col("id").isin(ids)).withColumn("programme", F.lit("draft"))
        u = x.select("programme", "id", F.explode("units").alias("u")).select("programme", "id", "u.title", F.regexp_replace("u.text", r"\s+Page(?:\s+\d+)?\s*$", "").alias("text"), "u.hours")
        g = u.groupBy("programme", "text").agg(F.min("title").alias("title"), F.max("hours").alias("hours"), F.array_sort(F.collect_set("id")).alias("sources"))
        if jobs is None:
            return A.draft(x, g).withColumn("status", F.lit(DRAFT_STATUS))
        if not 1 <= jobs.limit(11).count() <= 10:
            raise ValueError("give one to ten job descriptions")
        skills = written(A.skill_gaps(jobs, u, self.tau, min_jobs), "skills")
        wanted = g.join(skills.filter("kind = 'covered'").select("topic_key").distinct(), F.contains("text", "topic_key"), "left_semi")  # a few units and skills
        kept = g.filter(F.size("sources") >= 2).unionByName(wanted.filter(F.size("sources") < 2))
        p = jobs.select("job", F.explode(C.requirements(F.col("text"))).alias("r"))
        asked = p.select("job", "r", F.explode(A.skill_phrases(F.col("r"))).alias("p")).withColumn("k", reduced(F.col("p")))
        gaps = skills.filter((F.col("kind") == "gap") & (F.col("place") <= max_new)).withColumn("k", reduced(F.col("theme"))).join(asked, "k")
        new = gaps.groupBy("theme").agg(F.array_sort(F.collect_set("p")).alias("phrases"), F.array_sort(F.collect_set("r")).alias("reqs"), F.array_sort(F.collect_set(F.col("job").cast("string"))).alias("sources"))
        content = F.concat(F.lit("Topics: "), F.array_join("phrases", "; "), F.lit(". Industry requirements: "), F.array_join("reqs", " "))
        units = kept.unionByName(new.select(F.lit("draft").alias("programme"), content.alias("text"), C.unit_title(F.col("phrases"), F.col("theme")).alias("title"), F.lit(6).alias("hours"), "sources"))
        lab = skills.filter("kind = 'tool'").agg(F.array_sort(F.collect_set("theme")).alias("lab_environment"))
        return A.draft(x, units).crossJoin(lab).withColumn("status", F.lit(DRAFT_STATUS))

    def passages(self, draft: DataFrame, size: int = 100, overlap: int = 25) -> DataFrame:
        """A draft's units as numbered passages of ``size`` words with their section: rows for a knowledge base."""
        s = draft.select(F.posexplode("units").alias("page", "u")).select((F.col("page") + 1).alias("page"), F.concat(F.lit("Unit "), (F.col("page") + 1).cast("string"), F.lit(": "), F.coalesce("u.title", F.lit(""))).alias("section"), F.concat(F.coalesce("u.title", F.lit("")), F.lit(" ("), F.col("u.hours").cast("string"), F.lit(" hours). "), "u.text").alias("text"))
        p = s.select("page", "section", F.posexplode(C.passages(F.col("text"), size, overlap)).alias("i", "text"))
        return p.withColumn("chunk_id", F.format_string("C%04d", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("page", "i")) - 1)).select("chunk_id", "page", "section", "text")  # one draft

    def ask(self, passages: DataFrame, questions: DataFrame) -> DataFrame:
        """For each ``(q, question)`` the sentence of a passage that answers it best, with its section."""
        a = T.answers(passages, "chunk_id", "text", questions, "q", "question")
        return a.join(passages.select("chunk_id", "section", "page"), "chunk_id").select("q", F.col("sentence").alias("answer"), "section", "page", F.round("score", 3).alias("confidence"))

    def notice(self, draft: DataFrame, title: str) -> DataFrame:
        """``(doc_id, text)``: the announcement of a draft as another service takes it."""
        text = F.concat(F.lit(f"A draft syllabus for the course '{title}' has been prepared for the academic year "), F.coalesce("academic_year", F.lit("-")), F.lit(". It brings together the content of "), F.col("n_courses").cast("string"), F.lit(" courses. Prerequisites: "), F.coalesce(F.nullif(F.array_join("prerequisites", ", "), F.lit("")), F.lit("none listed")), F.lit(". Please review it and send comments."))
        return draft.select(F.concat(F.lit("curriculum-"), C.slug(F.lit(title)), F.lit("-"), F.coalesce("academic_year", F.lit(""))).alias("doc_id"), text.alias("text"))
