"""Column expressions of the course domain: names, years, semesters, programmes, outcome verbs, prerequisite phrases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from syllaweave.functions import rules
from syllaweave.functions.text import let, reduced, squeezed


def programme_of(folder: Column) -> Column:
    """Canonical programme of a folder name: the first rule that matches, else OTHER."""
    f, out = F.lower(F.trim(folder)), F.lit("OTHER")
    for pattern, name in reversed(rules.PROGRAMMES):
        out = F.when(f.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def sem_min(s: Column) -> Column:
    """Least semester number named in Roman numerals (to X) or as 1 to 10; NULL if there is none."""
    s = F.coalesce(s, F.lit(""))
    numerals = F.array(*map(F.lit, rules.ROMAN))
    roman = F.transform(F.regexp_extract_all(F.upper(s), F.lit(r"\b(VIII|VII|VI|IV|IX|V|III|II|I|X)\b"), F.lit(1)), lambda x: F.array_position(numerals, x).cast("int"))
    digits = F.transform(F.regexp_extract_all(s, F.lit(r"\b([1-9]|10)\b"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_min(F.concat(roman, digits))


def name_key(key: Column, name: Column) -> Column:
    """The reduced key, or the reduced name where it is NULL or empty; NULL without both."""
    return F.coalesce(F.nullif(reduced(key), F.lit("")), F.nullif(reduced(name), F.lit("")))


def code_key(c: Column) -> Column:
    """Upper-cased and cut to A-Z and 0-9; a code without a digit is missing (NULL)."""
    cut = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", "")
    return F.when(cut.rlike("[0-9]"), cut)


def year_key(c: Column) -> Column:
    """An academic year in any spelling as ``YYYY-YY``; NULL if there are no two consecutive years in it."""
    pattern = r"(\d{4}|\d{2})\D+(\d{4}|\d{2})"
    y, z = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    a, b = (F.substring(x, -2, 2).try_cast("int") for x in (y, z))
    return F.when((a + 1) % 100 == b, F.concat(F.lit("20"), F.substring(y, -2, 2), F.lit("-"), F.substring(z, -2, 2)))


def year_in_text(text: Column) -> Column:
    """The first academic year in running text, if its two years are consecutive."""
    y, z = (F.regexp_extract(text, rules.YEAR_IN_TEXT, i) for i in (1, 2))
    return F.when((y.try_cast("int") + 1) % 100 == z.try_cast("int"), F.concat(y, F.lit("-"), z))


def clean_name(name: Column) -> Column:
    """A course name without a trailing code, and out of an elective's brackets."""
    n = squeezed(F.regexp_replace(name, rules.NAME_CODE, ""))
    return squeezed(F.regexp_replace(F.regexp_replace(n, rules.ELECTIVE, "$1"), rules.NAME_REMARK, ""))


def line_key(line: Column) -> Column:
    """A line with its digit runs masked."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), r"\d+", "#")


def letters(text: Column, n: int) -> Column:
    """The first ``n`` runs of a-z of the lower-cased text."""
    return F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)), 1, n)


def first_word(text: Column) -> Column:
    """The action verb an outcome starts with: of seven words the first that carries meaning and isn't an adverb."""
    skip = F.array(*map(F.lit, rules.SKIP_WORDS.split()))
    return F.get(F.filter(letters(text, 7), lambda w: ~F.array_contains(skip, w) & ~w.endswith("ly")), F.lit(0))


def lexicon_level(text: Column) -> Column:
    """Bloom level of the first listed verb among five words; NULL if none is listed."""
    verbs = F.create_map(*[F.lit(x) for kv in rules.VERB_LEVEL.items() for x in kv])
    return F.try_element_at(verbs, F.get(F.filter(letters(text, 5), lambda w: F.map_contains_key(verbs, w)), F.lit(0)))


def bloom_name(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in rules.BLOOM_NAMES.items():
        out = F.when(level == k, F.lit(v)).otherwise(out)
    return out


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ .:\-–]+|[ .:\-–]+$", "")


def split_prerequisites(text: Column) -> Column:
    """Phrases of a prerequisite field, once each, in written order: the first rule set.

    NULL, empty and "none" fields give an empty array; phrases have 3 to 90 characters.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\(([^)]*\d[^)]*)\)", " ")
    parts = F.split(t, r"[;,\n]|\band\b|&|\bas well as\b|\bor\b|/")
    parts = F.transform(parts, lambda p: F.regexp_replace(strip_marks(squeezed(p)), rules.LEAD_IN, ""))
    parts = F.filter(parts, lambda p: (F.length(p) > 2) & (F.length(p) <= 90) & ~p.rlike(rules.NONE_PREREQUISITE))
    none = (F.trim(t) == "") | F.trim(t).rlike(rules.NONE_PREREQUISITE)
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(parts))


def split_prerequisites_v2(text: Column) -> Column:
    """Phrases of a prerequisite field, once each, in written order: the second rule set.

    Brackets and course codes go; joining words divide only where every side has two words or more; bare part numbers
    repeat the name before them, which an array fold carries along. NULL, empty and "none" fields give an empty array.
    """
    strings = F.array().cast("array<string>")
    t = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rules.PREREQUISITE_BRACKETS, " "), rules.PREREQUISITE_CODE, " ")

    def sides(piece: Column) -> Column:
        split = F.transform(F.split(piece, r"\band\b|&|\bas well as\b|\bor\b"), strip_marks)
        whole = F.forall(split, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 2)
        return F.when((F.size(split) > 1) & whole, split).otherwise(F.array(piece))

    parts = F.transform(F.split(t, r"[;,\n/]"), lambda p: F.regexp_replace(strip_marks(squeezed(p)), rules.LEAD_IN, ""))
    parts = F.transform(F.flatten(F.transform(parts, lambda p: let(p, sides))), lambda q: F.regexp_replace(q, rules.LEAD_IN, ""))

    def fold(out: Column, q: Column) -> Column:
        base = F.regexp_replace(F.element_at(out, -1), rules.PART_NUMBER_AT_END, "")
        numbered = F.transform(F.regexp_extract_all(q, F.lit(rules.PART_NUMBER), F.lit(0)), lambda n: F.concat(base, F.lit(" - "), F.upper(n)))
        named = (F.length(q) > 2) & (F.length(q) <= 90) & ~q.rlike(rules.NONE_PREREQUISITE)
        return F.concat(out, F.when((F.size(out) > 0) & q.rlike(rules.PART_NUMBERS), numbered).when(named, F.array(q)).otherwise(strings))

    none = (F.trim(t) == "") | F.trim(t).rlike(rules.NONE_PREREQUISITE)
    return F.when(none, strings).otherwise(F.array_distinct(F.aggregate(parts, strings, fold)))


def requirements(text: Column) -> Column:
    """Requirement statements of a job description: bullet lines or sentences of five words or more."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, rules.BULLET, "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(rules.JOB_HEADER) & ~x.endswith(":"))
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, r"(?<=[.;])\s+"), lambda x: F.trim(x))))
    return F.filter(parts, lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 5)


def unit_topics(text: Column) -> Column:
    """Topic phrases of a unit: separated items of more than three characters and at most twelve words."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[,;:.()]|\bv/s\b|\bvs\.?\b")
    parts = F.transform(parts, lambda t: F.regexp_replace(F.trim(t), r"^[ \-–]+|[ \-–]+$", ""))
    return F.filter(parts, lambda t: (F.length(t) > 3) & (F.size(F.split(t, r"\s+")) <= 12))


def passages(text: Column, size: int = 100, overlap: int = 25) -> Column:
    """Word windows of ``size`` words that overlap by ``overlap``; the last one reaches the end. No words: no window."""
    words = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    step = size - overlap

    def windows(w: Column) -> Column:
        last = F.ceil(F.greatest(F.size(w) - size, F.lit(0)) / step) * step
        return F.transform(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))

    return let(words, lambda w: F.when(F.size(w) > 0, windows(w)).otherwise(F.array().cast("array<string>")))


def first_words(text: Column, n: int, suffix: str = "") -> Column:
    """The first ``n`` words; ``suffix`` only where something was cut."""
    w = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(suffix)).otherwise(F.lit("")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def light_stem(w: Column) -> Column:
    return F.when(F.length(w) > 4, F.regexp_replace(w, "(?:ments?|ed|ing|es|s)$", "")).otherwise(w)


def unit_title(phrases: Column, default: Column) -> Column:
    """The longest phrase of at most five words (ties: the last in order), capitalised."""
    short = F.filter(phrases, lambda p: F.size(F.split(p, " ")) <= 5)
    best = F.element_at(F.array_sort(F.transform(short, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), -1)["p"]
    t = F.when(F.size(short) > 0, best).otherwise(default)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 20))


def course_text() -> Column:
    """Objectives, outcomes and units as one text."""
    return F.concat_ws(" ", F.coalesce("objectives", F.lit("")), F.col("outcomes.text"), F.col("units.text"))


def chunks() -> Column:
    """``ARRAY<STRUCT<label, text>>``: the units, else the outcomes, else the objectives."""
    units = F.transform("units", lambda u: F.struct(F.coalesce(F.nullif(u["title"], F.lit("")), first_words(u["text"], 8)).alias("label"), u["text"].alias("text")))
    outcomes = F.transform("outcomes", lambda o: F.struct(F.substring(o["text"], 1, 60).alias("label"), o["text"].alias("text")))
    none = F.array().cast("array<struct<label:string,text:string>>")
    objectives = F.when(F.coalesce("objectives", F.lit("")) != "", F.array(F.struct(F.lit("objectives").alias("label"), F.col("objectives").alias("text")))).otherwise(none)
    return F.when(F.size("units") > 0, units).when(F.size("outcomes") > 0, outcomes).otherwise(objectives)


def department(code: Column) -> Column:
    """The letters a course code starts with (after digits), else OTHER."""
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(code), "^[0-9]*([A-Z]{2,4})", 1), F.lit("")), F.lit("OTHER"))


def name_tokens(name: Column) -> Column:
    """Distinct words of a name with more than two letters, without function words."""
    from syllaweave.operators.lexical import STOP_WORDS

    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS.split())))


def same_phrase(a: Column, b: Column) -> Column:
    """The key of one phrase holds the key of the other; neither is empty."""
    x, y = reduced(a), reduced(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def computing(program: Column) -> Column:
    """The programme is a computing one; what follows "except" or "excluding" doesn't count."""
    return F.regexp_replace(F.coalesce(program, F.lit("")), r"(?i)\b(?:except|excluding)\b.*$", "").rlike(rules.COMPUTING)


def topics_in(text: Column) -> Column:
    """``MAP<topic, mentions>`` of the lexicon topics that a text names."""
    found = F.array(*(F.struct(F.lit(t).alias("key"), F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b(?:{p})"), F.lit(0))).alias("value")) for t, p in rules.TOPIC_LEXICON.items()))
    return F.map_from_entries(F.filter(found, lambda x: x["value"] > 0))


def word_groups(text: Column, size: int = 3, most: int = 40) -> Column:
    """Windows of ``size`` sentences, of more than four words each, at most ``most``."""
    s = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def windows(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        groups = F.transform(starts, lambda i: F.array_join(F.slice(x, i + 1, size), " "))
        return F.slice(F.filter(groups, lambda g: F.size(F.split(g, r"\s+")) > 4), 1, most)

    return let(s, windows)


def clean_page_text(text: Column) -> Column:
    """Text of a web page without addresses, file marks and credits, whitespace squeezed. Compatibility forms stay as they are."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+|\S+@\S+", " ")
    t = F.regexp_replace(t, r"(?i)\(\s*(?:PDF|MP4|ZIP|TXT|XLS)[^)]*\)", " ")
    return squeezed(F.regexp_replace(t, r"(?i)\b(?:courtesy of|image by|used with permission)[^.]*\.?", " "))


def keep_section(heading: Column) -> Column:
    """Sections with course content: a wanted heading always, an unwanted one never, any other one too."""
    h = F.lower(F.coalesce(heading, F.lit("")))
    return h.rlike(rules.KEEP_SECTION) | ~h.rlike(rules.DROP_SECTION)


def course_references(text: Column, own: Column) -> Column:
    """Sorted distinct course numbers that a text names, without its own."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rules.COURSE_REFERENCE), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~x.eqNullSafe(own))))


def phrase_tokens(phrase: Column) -> Column:
    """Distinct words of a phrase, Roman numerals as digits."""
    numerals = F.array(*(F.lit(r.lower()) for r in rules.ROMAN))
    words = F.regexp_extract_all(F.lower(F.coalesce(phrase, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.when(F.array_contains(numerals, w), F.array_position(numerals, w).cast("string")).otherwise(w)))
