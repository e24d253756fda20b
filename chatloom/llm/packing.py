"""Texts in containers of a fixed capacity, by bulk-synchronous best fit over sorted classes of sizes and gaps.

Sorted by size, documents of one size are interchangeable for packing, and so are containers with one gap left. The
range-sorted documents are therefore held as counts per size, which are at most ``capacity`` numbers however many
documents there are. Each round sweeps the sizes from the largest down: a size takes its successor, the smallest gap
that holds it; of several documents that want the same gaps the first by rank win, the others go on to the next gap in
the following step; sizes that no gap holds open containers. Gaps are updated in bulk after each match, and a size is
matched again until none of its documents is left. The outcome is a short list of rank intervals (documents a to b of size s go to
containers c to c + b - a), which is looked up for each document by its rank.

A document longer than the capacity is cut into full pieces and a rest; no other is divided. Defined results: null texts
are no items; a text without tokens takes no room and goes to container 0; equal sizes are placed in the order of a hash
of key and content, then key, then piece; repeated rows are placed each.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.storage import restored_key, written

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenization of byte-level BPE vocabularies with 50 thousand entries (a fixed value of that public format).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of one size are numbered in this many independent lists, so that no size is ranked by one task.
LISTS = 256
#: Items for which one list is meant.
LIST_ITEMS = 1 << 20
#: Ranks stay below this number.
RANKS = 1 << 44


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """Key, tokens of the whole text and a hash of its content, for texts that are not null."""
    kind = dict(documents.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = encoding(tokenizer)
        for frame in frames:
            n = [len(codec.encode_ordinary(t)) for t in frame["_t"]]
            yield pd.DataFrame({"_k": frame["_k"], "n_tokens": n, "_h": frame["_h"]})

    narrow = documents.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t"), F.xxhash64(key, text).alias("_h"))
    counted = narrow.where("_t is not null").mapInPandas(run, "_k string, n_tokens long, _h long")
    return restored_key(counted, key, kind)


def pieces(counts: DataFrame, capacity: int) -> DataFrame:
    """One row per piece: its number, first token and size."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    each = counts.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("piece") * capacity
    return each.withColumns({"start_token": start, "size": F.least(F.col("n_tokens") - start, F.lit(capacity))})


class Plan:
    """Best fit over classes: counts of documents by size against intervals of containers by gap."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.total = self.left.copy()
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.open = np.zeros(capacity + 1, bool)
        self.containers = 0
        self.rows: list[tuple[int, int, int, int]] = []

    def _place(self, size: int, n: int, spans: list[tuple[int, int]], gap: int) -> None:
        """Puts the next ``n`` documents of a size into the first ``n`` containers of the spans, which are used up."""
        while n:
            first, end = spans.pop()
            took = min(n, end - first)
            if took < end - first:
                spans.append((first + took, end))
            done = int(self.total[size] - self.left[size])
            self.rows.append((size, done, done + took, first))
            self.left[size] -= took
            n -= took
            if gap > size:
                self.gaps.setdefault(gap - size, []).append((first, first + took))
                self.open[gap - size] = True

    def match(self, size: int) -> None:
        """One bulk step: the remaining documents of a size meet their successor gap, the first by rank get its room."""
        fits = np.flatnonzero(self.open[size:])
        if len(fits):
            gap = size + int(fits[0])
            spans = self.gaps[gap]
            room = sum(e - s for s, e in spans)
            self._place(size, min(room, int(self.left[size])), spans, gap)
            if not spans:
                del self.gaps[gap]
                self.open[gap] = False
            return
        # No gap holds the size: open as many containers as hold the rest of it side by side.
        new = -(-int(self.left[size]) // (self.capacity // size))
        self._place(size, new, [(self.containers, self.containers + new)], self.capacity)
        self.containers += new

    def run(self) -> list[tuple[int, int, int, int]]:
        """(size, first rank, end rank, first container) of all documents, the sizes swept from the largest down."""
        for size in np.flatnonzero(self.left)[::-1]:
            while size and self.left[size]:
                self.match(int(size))
        if self.left[0]:
            self.containers = max(self.containers, 1)
        return self.rows


def ranked(items: DataFrame, key: str, lists: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Items with their rank among those of one size, and the number of items by size.

    Ranks count inside (size, list) and are moved by the sizes of the lists before. The number of lists follows the
    number of items, so that a size that all of them share, as the full pieces of long texts do, is spread as well.
    """
    lists = lists or max(LISTS, items.count() // LIST_ITEMS)
    listed = items.withColumn("_list", F.pmod("_h", F.lit(lists)).cast("int"))
    sums = listed.groupBy("size", "_list").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("size").orderBy("_list").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "packing-offsets")
    inner = Window.partitionBy("size", "_list").orderBy("_h", key, "piece")
    rows = listed.withColumn("_inner", F.row_number().over(inner) - 1).join(offsets.drop("_n"), ["size", "_list"])
    counts = {r["size"]: r["n"] for r in offsets.groupBy("size").agg(F.sum("_n").alias("n")).collect()}
    return rows.withColumn("rank", F.col("_inner") + F.col("_before")).drop("_inner", "_before", "_list"), counts


def pack(documents: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: key, piece, first token, size and container."""
    items = written(pieces(token_counts(documents, key, text, tokenizer), capacity), "packing-items")
    rows, counts = ranked(items, key)
    plan = np.array(sorted(Plan(counts, capacity).run()), np.int64).reshape(-1, 4)
    starts = plan[:, 0] * RANKS + plan[:, 1]
    shared = documents.sparkSession.sparkContext.broadcast((starts, plan[:, 1], plan[:, 3]))

    @F.pandas_udf("long")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        starts, first, base = shared.value
        for size, rank in batches:
            at = np.searchsorted(starts, size.to_numpy() * RANKS + rank.to_numpy(), side="right") - 1
            yield pd.Series(np.where(size == 0, 0, base[at] + rank - first[at] if len(starts) else 0))

    place = container(F.col("size"), F.col("rank")).alias("container_id")
    return rows.select(key, "piece", "start_token", "size", place)


def invariants(packed: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """One row that tells whether the packing is whole: documents placed, those whose pieces do not make up the document
    from its first to its last token, containers above the capacity, documents divided that would have fitted."""
    each = packed.groupBy(key).agg(F.sum("size").alias("_all"), F.max(F.col("start_token") + F.col("size")).alias("_end"), F.count(F.lit(1)).alias("_n"))
    docs = each.agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("_all") != F.col("_end")).alias("n_gaps"),
        F.count_if((F.col("_n") > 1) & (F.col("_all") <= capacity)).alias("n_divided_without_need"),
    )
    full = packed.groupBy("container_id").agg(F.sum("size").alias("_used")).agg(F.count_if(F.col("_used") > capacity).alias("n_overfull"))
    return docs.join(F.broadcast(full), F.lit(True)).select("n_docs", "n_gaps", "n_overfull", "n_divided_without_need")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, share of used room and the least number of containers that could do."""
    each = packed.groupBy("container_id").agg(F.sum("size").alias("used"))
    total = F.sum("used")
    return each.agg(
        F.count(F.lit(1)).alias("n_containers"), total.alias("n_tokens"), F.max("used").alias("fullest"),
        (total / (F.count(F.lit(1)) * capacity)).alias("fill"), F.ceil(total / capacity).alias("least_containers"),
    )
