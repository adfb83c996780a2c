"""Filling fixed-capacity containers: bounded-space online best fit.

Items are streamed in the order of their keys' hashes within independent partitions. A partition keeps at most ``open_bins``
open containers, indexed by a bitset over free space: the lowest set bit at or above an item's size is the best fit. If
none fits, a container is opened, and if too many are open the fullest one closes. Only an item larger than the capacity
is divided: its full pieces fill containers of their own and the rest is an item like any other. Partitions are sized by
tokens, so the containers left open at their ends stay a fixed small share at every scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from syllaweave.session import written

#: Maximal runs of letters, digits and ``_``, and maximal runs of other non-space characters.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}]+"
PACKED = "key bigint, tokens bigint, piece int, pieces int, token_from bigint, token_to bigint, container bigint"


def token_count(text: Column) -> Column:
    """Tokens of the public WordPunct rule; NULL has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PUNCT)).cast("bigint")


def vocabulary_token_count(text: Column, path: str):
    """Tokens of a public tokenizer file (``tokenizers`` JSON) at ``path``, in Arrow batches."""
    @F.pandas_udf("bigint")
    def count(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return pd.Series([len(e.ids) for e in t.encode_batch(s.fillna("").tolist(), add_special_tokens=False)], dtype="int64")

    return count(text)


class BestFit:
    """Containers of one stream; ``put`` returns the container's number."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most, self.bits, self.count, self.next = capacity, open_bins, 0, 0, 0
        self.at: dict[int, list[int]] = {}

    def take(self) -> int:
        self.next += 1
        return self.next - 1

    def _pop(self, free: int) -> int:
        stack = self.at[free]
        n = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.count -= 1
        return n

    def put(self, size: int) -> int:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            n = self._pop(free)
        else:
            if self.count == self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)
            free, n = self.capacity, self.take()
        if left := free - size:
            self.at.setdefault(left, []).append(n)
            self.bits |= 1 << left
            self.count += 1
        return n


def _packer(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36
        for rb in batches:
            rows = []
            for key, size in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                full, rest = divmod(size, capacity) if size > capacity else (0, size)
                pieces = full + (rest > 0 or not full)
                for p in range(full):
                    rows.append((key, size, p + 1, pieces, p * capacity, (p + 1) * capacity, base + bins.take()))
                if pieces > full:
                    rows.append((key, size, pieces, pieces, full * capacity, size, base + bins.put(rest)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "tokens", "piece", "pieces", "token_from", "token_to", "container"])

    return run


def pack(df: DataFrame, key: str, tokens: Column, capacity: int = 1024, open_bins: int = 64, containers_per_stream: int = 4096) -> DataFrame:
    """One row for each piece of each item: its container and its token range ``[token_from, token_to)``.

    Rows delivered twice count once; an item without tokens is put beside others and takes no room; NULL keys are
    items too; ties go to the container opened last; an empty table gives no rows. An item of exactly ``capacity``
    tokens isn't divided.
    """
    sizes = written(df.select(F.col(key).cast("bigint").alias("key"), tokens.alias("tokens")).distinct(), "sizes")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    streams = max(1, round(total / (capacity * containers_per_stream)))
    ordered = sizes.repartition(streams, "key").sortWithinPartitions(F.xxhash64("key"), "key", "tokens")
    return ordered.select("key", "tokens").mapInArrow(_packer(capacity, open_bins), PACKED)
