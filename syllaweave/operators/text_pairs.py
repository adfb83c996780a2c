"""Complete cosine pairs of TF-IDF vectors straight from texts: what is shuffled are term counts and the texts themselves.

A text is far smaller than its vector, so the tasks take texts, make the vectors there with one table of document
frequencies, and multiply within a group. Terms are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from syllaweave.operators import lexical as L
from syllaweave.session import small, written

#: Terms with document frequencies up to which the table goes to the workers (12 bytes each); beyond it vectors are joined.
VOCABULARY = 8_000_000
#: Documents of a block: a group with more is compared in pairs of blocks.
BLOCK = 12_000
#: Products of two prefix terms, or terms looked up, that are held at once.
STEP = 4_000_000

_KINDS = np.random.default_rng(11)
_OF_BYTE, _BASE = _KINDS.integers(0, 2**64, 256, dtype=np.uint64), np.uint64(int(_KINDS.integers(0, 2**63)) * 2 + 1)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the text and hash of each run of two or more of a-z and 0-9, in order."""
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    inside, edge = _IN_WORD[data], np.zeros(len(data) + 1, bool)
    edge[off] = True
    begin = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside])[:-1]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside, [False]])[1:])) + 1
    size = end - begin
    begin, size = begin[size > 1], size[size > 1]
    h, open_, k = np.zeros(len(begin), np.uint64), np.arange(len(begin)), 0
    while len(open_):
        h[open_] = h[open_] * _BASE + _OF_BYTE[data[begin[open_] + k]]
        k += 1
        open_ = open_[size[open_] > k]
    return np.searchsorted(off, begin, side="right") - 1, _mixed(h)


_STOP = np.sort(_hashed_words(pa.array(L.STOP_WORDS.split(), pa.string()))[1])


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``values`` are in the sorted ``known``, and where those are."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    have = known[at] == values
    return have, at[have]


def term_counts(texts: pa.ListArray, ngrams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, hash, tf)`` by row and hash: the terms of :func:`lexical.counts` for up to two words, of lists of lower-case texts."""
    if ngrams not in (1, 2):
        raise ValueError("terms have one word or two")
    of_text = np.repeat(np.arange(len(texts)), np.diff(texts.offsets.to_numpy()))
    text, h = _hashed_words(texts.flatten())
    keep = ~_among(h, _STOP)[0]
    text, h = text[keep], h[keep]
    row = of_text[text] if len(text) else np.zeros(0, np.int64)
    if ngrams == 2:
        near = text[1:] == text[:-1]
        pair = _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[1:]))[near]
        row, h = np.concatenate([row, row[:-1][near]]), np.concatenate([h, pair])
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.int32), kind="stable")]
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    h, c = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first, dtype=c.dtype) if len(first) else c


def _frequencies(docs: DataFrame, ngrams: int, least: int, most: float) -> DataFrame:
    """``(n, hashes, dfs)``: sorted hashes (BIGINT bit patterns) and document frequencies, in bytes, of shares of all terms."""
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            _, h, _ = term_counts(rb.column(0), ngrams)
            h, c = _summed(h, np.ones(len(h), np.int32))
            cut = np.searchsorted(h, (np.arange(1, parts, dtype=np.uint64) << np.uint64(58)))
            each = [(k, x.tobytes(), y.tobytes()) for k, (x, y) in enumerate(zip(np.split(h, cut), np.split(c, cut)))]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in each], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["part", "h", "c"])

    def add(_key, table: pa.Table) -> pa.Table:  # noqa: ANN001
        h, c = (np.frombuffer(b"".join(table.column(x).to_pylist()), t) for x, t in (("h", np.uint64), ("c", np.int32)))
        h, c = _summed(h, c.astype(np.int64))
        keep = (c >= least) & (c <= most)
        return pa.table({"n": [int(keep.sum())], "hashes": pa.array([h[keep].tobytes()], pa.binary()), "dfs": pa.array([c[keep].astype(np.int32).tobytes()], pa.binary())})

    return docs.select("texts").mapInArrow(count, "part int, h binary, c binary").groupBy("part").applyInArrow(lambda k, t: add(k, t), "n bigint, hashes binary, dfs binary")


def _pairs(row: np.ndarray, rank: np.ndarray, w: np.ndarray, n: int, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, sim)`` with ``a`` < ``b`` and a dot product >= ``threshold``, complete; of different ``side`` if that is given.

    ``rank`` orders the terms from rare to frequent; entries are sorted by row and rank, rows have unit length. Two rows
    meet in a term of both prefixes. The terms up to where the shorter prefix ends are summed exactly by that; what the
    rest can add is at most the product of the two remaining lengths, which leaves few pairs to look up.
    """
    if not len(row):
        return
    span = np.int64(rank.max()) + 2
    key = row * span + rank
    size = np.bincount(row, minlength=n)
    begin = np.cumsum(size) - size
    total = np.concatenate([[0.0], np.cumsum(w * w)])
    rest = np.maximum(total[(begin + size)[row]] - total[:-1], 0)  # squared length of this term and all after it
    prefix = np.sqrt(rest) >= threshold - 1e-9
    count = np.bincount(row[prefix], minlength=n)
    last = np.where(count > 0, rank[np.maximum(begin + count - 1, 0).clip(0, len(rank) - 1)], -1)
    after = lambda r, e: np.maximum(total[(begin + size)[r]] - total[np.searchsorted(key, r * span + e, side="right")], 0)

    p = np.flatnonzero(prefix)
    p = p[np.lexsort((row[p], rank[p]))]  # the prefix entries of a term, rows in order
    t = rank[p]
    stop = np.searchsorted(t, t, side="right")
    more = stop - np.arange(len(p)) - 1  # the entries of the term that come later
    by_row = np.argsort(row[p], kind="stable")
    work = np.cumsum(more[by_row])
    ends = np.searchsorted(row[p][by_row], np.arange(n), side="right")  # a chunk ends with a row
    at = 0
    while at < len(p):
        done = work[at - 1] if at else 0
        fit = ends[np.searchsorted(work[np.maximum(ends - 1, 0)], done + STEP, side="right").clip(0, n) - 1] if n else 0
        upto = int(fit) if fit > at else int(ends[row[p][by_row[at]]])
        mine = by_row[at:upto]
        at = upto
        m = more[mine]
        left = np.repeat(mine, m)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        if side is not None:
            ok = side[row[p[left]]] != side[row[p[right]]]
            left, right = left[ok], right[ok]
        k = row[p[left]] * n + row[p[right]]
        order = np.argsort(k)
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        if not len(first):
            continue
        partial = np.add.reduceat((w[p[left]] * w[p[right]])[order], first)
        a, b = k[first] // n, k[first] % n
        e = np.minimum(last[a], last[b])
        ok = partial + np.sqrt(after(a, e) * after(b, e)) >= threshold - 1e-9
        a, b = a[ok], b[ok]
        short = np.where(size[a] <= size[b], a, b)
        other = a + b - short
        cut = np.searchsorted(np.cumsum(size[short]), np.arange(STEP, size[short].sum() + 1, STEP))
        for i in np.split(np.arange(len(a)), np.unique(cut)):
            if not len(i):
                continue
            s = size[short[i]]
            entry = np.repeat(begin[short[i]] - np.cumsum(s) + s, s) + np.arange(s.sum())
            pair = np.repeat(np.arange(len(i)), s)
            have, where = _among(other[i][pair] * span + rank[entry], key)
            sim = np.bincount(pair[have], w[entry[have]] * w[where], len(i))
            yield a[i][sim >= threshold], b[i][sim >= threshold], sim[sim >= threshold]


def text_pairs(docs: DataFrame, doc: str, group: str, text: Column, threshold: float, ngrams: int = 1, min_df: int = 2, max_df: float = 0.8, bound: int = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """``(group, doc_a, doc_b, sim)`` of rows of one group with a TF-IDF cosine >= ``threshold``, complete.

    Weights as in :func:`lexical.tfidf` over :func:`lexical.counts`; frequencies count every row, pairs need a key and a
    group. Rows with equal keys add up. The table of frequencies goes to the workers if it has at most ``bound`` terms,
    else :func:`lexical.cosine_pairs` joins the vectors. The result is a stage table.
    """
    spark, kinds = docs.sparkSession, dict(docs.dtypes)
    n_docs = docs.count()
    x = docs.select(F.col(group).alias("group"), F.col(doc).alias("doc"), F.array(F.lower(F.coalesce(text, F.lit("")))).alias("texts"))
    if not x.groupBy("group", "doc").count().filter("count > 1").isEmpty():
        x = x.groupBy("group", "doc").agg(F.flatten(F.collect_list("texts")).alias("texts"))  # the copies of one key
    vocabulary = written(_frequencies(x, ngrams, min_df, max_df * n_docs), "frequencies")
    if (vocabulary.agg(F.sum("n")).first()[0] or 0) > bound:
        w = L.tfidf(L.counts(docs, [group, doc], text, ngrams), [group, doc], n_docs, min_df=min_df, max_df=max_df)
        return written(L.cosine_pairs(w, doc, group, threshold), "pairs")
    rows = vocabulary.select("hashes", "dfs").collect()
    hashes, dfs = (np.frombuffer(b"".join(bytes(r[i]) for r in rows), t) for i, t in enumerate((np.uint64, np.int32)))
    order = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[order], dfs[order]))
    del rows, hashes, dfs

    def compare(key, table: pa.Table) -> pa.Table:  # noqa: ANN001
        i, j = key[1].as_py(), key[2].as_py()
        table = table.take(pc.sort_indices(table.column("doc"))).combine_chunks()
        known, df = sent.value
        parts = [term_counts(c, ngrams) for c in table.column("texts").chunks] or [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        row, h, tf = parts[0]
        have, at = _among(h, known)
        row, tf, d = row[have].astype(np.int64), tf[have], df[at].astype(np.int64)
        w = (1 + np.log(tf)) * (np.log((1.0 + n_docs) / (1.0 + d)) + 1)
        w = w / np.sqrt(np.bincount(row, w * w, table.num_rows))[row]
        terms, local = np.unique(d << 32 | at, return_inverse=True)
        order = np.argsort(row * np.int64(len(terms) + 1) + local)
        side = table.column("block").to_numpy() if i != j else None
        found = list(_pairs(row[order], local[order].astype(np.int64), w[order], table.num_rows, side, threshold))
        a, b, sim = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 2 else float) for k in range(3))
        ids = table.column("doc")
        return pa.table([table.column("group").take(pa.array(a)), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(sim)], ["group", "doc_a", "doc_b", "sim"])

    sizes = x.filter("group is not null and doc is not null").groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1")
    y = x.filter("group is not null and doc is not null").join(small(sizes), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    y = y.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    y = y.select("group", "doc", "block", "texts", F.explode(cells).alias("c")).select("group", "doc", "block", "texts", "c.i", "c.j")
    got = y.groupBy("group", "i", "j").applyInArrow(lambda k, t: compare(k, t), f"group {kinds[group]}, doc_a {kinds[doc]}, doc_b {kinds[doc]}, sim double")
    out = written(got.withColumnRenamed("group", group), "pairs")
    sent.destroy()
    return out
