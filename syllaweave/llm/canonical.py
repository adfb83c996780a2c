"""Mapping free-entered values to a canonical list, over a BK-tree under the Levenshtein distance.

The tree holds the distinct base names (reduced, without a trailing part number) and is walked level by level for all
values of a batch at once: the triangle inequality drops the subtrees that can't hold an entry within the radius, and
bit-parallel distances are computed for the rest, so every entry within the radius is returned. A value is looked up in
a few forms: without decoration (``Basics of ...``, ``... course``), with ``of`` resolved, and with its words turned
around (``Processing, Wireless``). Where no form is within a distance of one, words are compared one by one (an
abbreviation is a subsequence of the word with the same first letter; other words within a small distance come from a
second tree over the list's words), and a single short word as initials of one entry.

Every distinct value is matched once. A list of up to SHARD entries goes to the workers whole; a longer one is cut into
shards, and the candidates of every stage, not just a winner, come back from each, so that one rule decides over all of
them and the number of shards changes nothing.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from syllaweave.session import BROADCAST_KEYS, bounded_rows, small, written

U = np.uint64
#: Entries in a shard of the list, and distinct values that meet a shard in one task.
SHARD, PART = 20_000, 50_000
#: Words that decorate a name.
BEFORE = [
    "introduction to", "intro to", "basics of", "basic knowledge of", "working knowledge of", "knowledge of", "prior exposure to", "exposure to",
    "fundamentals of", "concepts of", "elements of", "completion of", "elementary", "basic",
]
AFTER = ["basics", "course", "paper", "lab", "fields"]
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower().replace("&", " and "))


def numbered(words: list[str]) -> tuple[list[str], int]:
    """Words without a trailing part number, and that number (0: none)."""
    if len(words) > 1 and (words[-1] in ROMAN or re.fullmatch(r"\d", words[-1])):
        n = ROMAN.get(words[-1]) or int(words[-1])
        rest = words[:-1]
        return (rest[:-1] if len(rest) > 1 and rest[-1] == "part" else rest), n
    return words, 0


def radius(length: int) -> int:
    """Edits that a name of this many characters may have."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 10 else 3 if length < 13 else 4


def encode(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in names], np.int64)
    codes = np.zeros((len(names), max(1, n.max(initial=0))), np.uint8)
    for i, x in enumerate(names):
        codes[i, : len(x)] = [ALPHABET[c] for c in x]
    return codes, n


def distances(q: np.ndarray, qn: np.ndarray, peq: np.ndarray, e: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs (query q[i] of at most 64 characters, entry e[i]), bit-parallel over the query."""
    m = qn[q].astype(U)
    top = U(1) << np.maximum(m, U(1)) - U(1)
    pv, mv = np.full(len(q), ~U(0)), np.zeros(len(q), U)
    score, en = m.astype(np.int64), n[e]
    for j in range(int(en.max(initial=0))):
        eq = peq[q, codes[e, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        on = j < en
        score += on & ((ph & top) != 0)
        score -= on & ((mh & top) != 0)
        ph, mh = (ph << U(1)) | U(1), mh << U(1)
        pv, mv = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, en, score)


def patterns(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bit masks of each character in each query, for :func:`distances`."""
    peq = np.zeros((len(names), 37), U)
    for i, x in enumerate(names):
        for k, c in enumerate(x):
            peq[i, ALPHABET[c]] |= U(1) << U(k)
    return peq, np.array([len(x) for x in names], np.int64)


def slow_distance(a: str, b: str) -> int:
    """Levenshtein distance, for names of more than 64 characters."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class BKTree:
    """Entries by their distance to their parent: children of a node have distinct distances to it."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.long = [i for i, x in enumerate(names) if len(x) > 64]
        short = np.array([i for i, x in enumerate(names) if len(x) <= 64], np.int64)
        self.codes, self.n = encode([x if len(x) <= 64 else "" for x in names])
        peq, qn = patterns([x if len(x) <= 64 else "" for x in names])
        self.root = int(short[0]) if len(short) else -1
        kids: dict[int, list[tuple[int, int]]] = {}
        todo = [(self.root, short[1:])] if len(short) else []
        while todo:
            # one distance computation for all nodes of a level
            node = np.concatenate([np.full(len(r), p) for p, r in todo]).astype(np.int64)
            rest = np.concatenate([r for _, r in todo])
            if not len(rest):
                break
            d = distances(node, qn, peq, rest, self.codes, self.n)
            order = np.lexsort((rest, d, node))
            node, rest, d = node[order], rest[order], d[order]
            edge = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (d[1:] != d[:-1]), [True]]))
            todo = []
            for a, b in zip(edge[:-1], edge[1:]):
                kids.setdefault(int(node[a]), []).append((int(rest[a]), int(d[a])))
                todo.append((int(rest[a]), rest[a + 1 : b]))
        self.first = np.zeros(len(names) + 1, np.int64)
        child, dist = [], []
        for i in range(len(names)):
            for c, w in kids.get(i, ()):
                child.append(c)
                dist.append(w)
            self.first[i + 1] = len(child)
        self.child, self.dist = np.array(child, np.int64), np.array(dist, np.int64)

    def search(self, queries: list[str], r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query index, entry and distance of every entry within the query's radius."""
        from syllaweave.llm.batch import expand

        far = [(i, k, slow_distance(q, self.names[k])) for i, q in enumerate(queries) for k in (range(len(self.names)) if len(q) > 64 else self.long) if abs(len(q) - len(self.names[k])) <= r[i]]
        out = [[np.array([x[j] for x in far if x[2] <= r[x[0]]], np.int64)] for j in range(3)]
        if self.root >= 0 and queries:
            peq, qn = patterns([q if len(q) <= 64 else "" for q in queries])
            q = np.array([i for i, x in enumerate(queries) if len(x) <= 64], np.int64)
            node = np.full(len(q), self.root)
            while len(q):
                d = np.concatenate([distances(q[k : k + 200_000], qn, peq, node[k : k + 200_000], self.codes, self.n) for k in range(0, len(q), 200_000)])
                hit = d <= r[q]
                for j, x in enumerate((q, node, d)):
                    out[j].append(x[hit])
                edge, owner = expand(self.first[node], self.first[node + 1] - self.first[node])
                keep = np.abs(self.dist[edge] - d[owner]) <= r[q[owner]]
                q, node = q[owner[keep]], self.child[edge[keep]]
        return tuple(np.concatenate(x) for x in out)


def abbreviates(short: str, word: str) -> bool:
    """``short`` is a subsequence of ``word``, shorter than it, with the same first letter."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    it = iter(word.replace("z", "s"))
    return all(c in it for c in short.replace("z", "s"))


class Catalogue:
    """A shard of the reference list: entry number, name, and rank (0: canonical name, 1: former name)."""

    def __init__(self, entries: list[tuple[int, str, int]]) -> None:
        self.of_base: dict[str, list[tuple[int, int, int]]] = {}
        self.words: dict[str, list[str]] = {}
        self.initials: tuple[dict[tuple[str, int], set[int]], ...] = ({}, {})
        for no, name, rank in entries:
            w, part = numbered(tokens(name))
            if not w:
                continue
            base = "".join(w)
            self.of_base.setdefault(base, []).append((part, rank, no))
            self.words.setdefault(base, [x for x in w if x not in ("and", "of")])
            self.initials[min(rank, 1)].setdefault(("".join(x[0] for x in w if x not in ("and", "of")), part), set()).add(no)
        self.bases = sorted(self.of_base)
        self.tree = BKTree(self.bases)
        self.vocabulary = sorted({x for w in self.words.values() for x in w})
        self.word_tree = BKTree(self.vocabulary)
        self.by_letter: dict[str, list[str]] = {}
        for v in self.vocabulary:
            self.by_letter.setdefault(v[0], []).append(v)
        self.by_count: dict[int, list[str]] = {}
        for b in self.bases:
            self.by_count.setdefault(len(self.words[b]), []).append(b)
        self.known: dict[str, dict[str, int]] = {}

    def forms(self, words: list[str]) -> list[list[str]]:
        """Word lists that the value may stand for, the value as written first."""
        out = [words]
        text = " ".join(words)
        for b in BEFORE:
            if text.startswith(b + " "):
                out.append(words[len(b.split()):])
                break
        for w in list(out):
            if len(w) > 1 and w[-1] in AFTER:
                out.append(w[:-1])
        for w in list(out):
            bare = [x for x in w if x != "of"]
            for v in ([w] if bare == w else [bare]):
                if 2 <= len(v) <= 6:
                    out += [v[k:] + v[:k] for k in range(0 if v is bare and bare != w else 1, len(v))]
        return out

    def best(self, candidates: list[tuple[int, str, int]], part: int) -> tuple[int, int, int] | None:
        """The least (distance, rank, number) among candidates ``(distance, base, part of the form)``."""
        found = [(d, rank, no) for d, base, p in candidates for pp, rank, no in self.of_base[base] if pp == p]
        return min(found, default=None)

    def learn(self, words: set[str]) -> None:
        """Words of the list that each of ``words`` may stand for, with a cost."""
        if len(self.known) > 500_000:
            self.known.clear()
        new = sorted(words - self.known.keys())
        near: dict[str, list[tuple[str, int]]] = {w: [] for w in new}
        long = [w for w in new if len(w) >= 4]
        for q, e, d in zip(*(x.tolist() for x in self.word_tree.search(long, np.full(len(long), 2)))):
            v = self.vocabulary[e]
            if len(v) >= 4 and d <= (1 if len(v) < 6 else 2):
                near[long[q]].append((v, d))
        for w in new:
            out = {}
            shorter = {w[:k] + w[k + 1 :] for k in range(1, len(w))} if len(w) >= 4 else set()
            for v in self.by_letter.get(w[0], ()):
                if abbreviates(w, v):
                    out[v] = 1 if v.startswith(w) else 2
                elif any(abbreviates(x, v) for x in shorter):
                    out[v] = 4
            for v, d in near[w]:
                # an abbreviation costs what it costs; a slip of the pen costs its distance
                if out.get(v, 4) == 4:
                    out[v] = d
            self.known[w] = out if w not in self.by_letter.get(w[0], ()) else {**out, w: 0}

    def by_words(self, forms: list[tuple[list[str], int]]) -> list[tuple[int, int, int]]:
        """(cost, rank, number) of the cheapest entries, two different ones at most."""
        found = []
        for w, part in forms:
            w = [x for x in w if x not in ("and", "of")]
            if not w or not all(costs := [self.known[x] for x in w]):
                continue
            for b in self.by_count.get(len(w), ()):
                if all(v in c for v, c in zip(self.words[b], costs)):
                    found += [(sum(c[v] for v, c in zip(self.words[b], costs)), rank, no) for p, rank, no in self.of_base[b] if p == part]
        return _cheapest(found)

    def candidates(self, values: list[str]) -> list[list]:
        """Of each value: the best entry by distance, the cheapest by words, and the entries its initials stand for."""
        split = []
        queries: list[str] = []
        owner: list[tuple[int, int]] = []
        for i, v in enumerate(values):
            forms = [numbered(f) for f in self.forms(tokens(v))]
            w, part = numbered(tokens(v))
            forms += [(f, part) for f in self.forms(w)] if part else []
            seen: dict[tuple[str, int], list[str]] = {}
            for f, p in forms:
                if f:
                    seen.setdefault(("".join(f), p), f)
            split.append([(f, p) for (_, p), f in seen.items()])
            for (base, p), _ in seen.items():
                queries.append(base)
                owner.append((i, p))
        r = np.array([radius(len(q)) for q in queries], np.int64)
        cand: dict[int, list[tuple[int, str, int]]] = {}
        for q, e, d in zip(*(x.tolist() for x in self.tree.search(queries, r))):
            i, p = owner[q]
            cand.setdefault(i, []).append((d, self.bases[e], p))
        first = [self.best(cand.get(i, []), 0) for i in range(len(values))]
        open_ = [i for i, got in enumerate(first) if got is None or got[0] > 1]
        self.learn({x for i in open_ for f, _ in split[i] for x in f if x not in ("and", "of")})
        out = [[got and list(got), [], []] for got in first]
        for i in open_:
            out[i][1] = self.by_words(split[i])
            if first[i] is None:
                short = [(f[0], p) for f, p in split[i] if len(f) == 1 and 2 <= len(f[0]) <= 6]
                out[i][2] = [[rank, n, no] for rank in (0, 1) for n, k in enumerate(short) for no in sorted(self.initials[rank].get(k, ()))[:2]]
        return out

    def match(self, values: list[str]) -> list[tuple[int, int, int, int]]:
        """(number, distance, rank, stage) of each value; number 0 and stage 9 where the list has none."""
        return [decide([c]) for c in self.candidates(values)]


def _cheapest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (cost, rank, number) the least, and the least of another number at the same cost."""
    found = sorted(map(tuple, found))
    return found[:1] + [x for x in found if x[0] == found[0][0] and x[2] != found[0][2]][:1] if found else []


def decide(shards: list[list]) -> tuple[int, int, int, int]:
    """One rule over the candidates of all shards.

    The entry of the least distance; if that is more than one, an entry that is cheaper word by word, if no other is as
    cheap; else the entry of the initials, canonical names and fuller forms first, if no other has them.
    """
    got, stage = min((tuple(c[0]) for c in shards if c[0]), default=None), 1
    if got is None or got[0] > 1:
        by = _cheapest([x for c in shards for x in c[1]])
        if len(by) == 1 and (got is None or by[0][0] < got[0]):
            got, stage = by[0], 2
    if got is None:
        named = sorted(tuple(x) for c in shards for x in c[2])
        same = {x[2] for x in named if x[:2] == named[0][:2]} if named else set()
        if len(same) == 1:
            got, stage = (0, named[0][0], named[0][2]), 3
    return (got[2], got[0], got[1], stage) if got else (0, 0, 0, 9)


RESULT = "entry bigint, distance int, rank int, stage int"


def _results(values: pa.Array, got: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([values, *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32())))], ["_value", "entry", "distance", "rank", "stage"])


def _matcher(entries: list[tuple[int, str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue(entries)
        for rb in batches:
            yield _results(rb.column(0), catalogue.match([v or "" for v in rb.column(0).to_pylist()]))

    return run


def _shard_candidates(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """Candidates of a part of the values in one shard of the list."""
    if not len(values):
        return pd.DataFrame({"_value": [], "cand": []})
    catalogue = Catalogue(sorted(zip(entries["entry"].astype(int), entries["name"], entries["rank"].astype(int))))
    return pd.DataFrame({"_value": values["_value"], "cand": [json.dumps(c) for c in catalogue.candidates([v or "" for v in values["_value"]])]})


def _decider(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        yield _results(rb.column(0), [decide([json.loads(c) for c in cs]) for cs in rb.column(1).to_pylist()])


def map_values(df: DataFrame, value: str, entries: DataFrame, shard: int = SHARD) -> DataFrame:
    """``df`` with the entry that each value means: ``entry`` (0: none), ``distance``, ``rank`` and ``stage``.

    ``entries`` has ``entry BIGINT, name STRING, rank INT``. NULL and empty values mean none; equal distances go to the
    canonical name, then to the least entry; an empty list matches nothing; repeated rows stay repeated. Columns of ``df``
    that are named like one of the result get ``_in`` appended.
    """
    clean = entries.filter(F.col("entry").isNotNull() & F.col("name").isNotNull()).select(F.col("entry").cast("bigint"), F.col("name").cast("string"), F.col("rank").cast("int")).distinct()
    keep = [c for c in df.columns if c != value] + [value]
    base = df.select(*keep).withColumnsRenamed({c: f"{c}_in" for c in ("entry", "distance", "rank", "stage") if c in keep and c != value})
    values = base.select(F.col(value).cast("string").alias("_value")).distinct()
    listed = bounded_rows(clean, shard)
    if listed is not None:
        found = values.mapInArrow(_matcher(sorted(map(tuple, listed))), f"_value string, {RESULT}")
    else:
        shards, parts = math.ceil(clean.count() / shard), max(1, math.ceil(values.count() / PART))
        cut = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        v = values.withColumn("part", cut("_value", parts)).withColumn("shard", every(shards))
        e = clean.withColumn("shard", cut("entry", shards)).withColumn("part", every(parts))
        by_shard = v.groupBy("shard", "part").cogroup(e.groupBy("shard", "part")).applyInPandas(_shard_candidates, "_value string, cand string")
        found = by_shard.groupBy("_value").agg(F.collect_list("cand")).mapInArrow(_decider, f"_value string, {RESULT}")  # a candidate row for each shard
    found = written(found, "mapped")
    return base.join(small(found, BROADCAST_KEYS), F.col(value).cast("string").eqNullSafe(F.col("_value")), "left").drop("_value")
