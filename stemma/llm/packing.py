"""Best-fit packing by sums of squares.

A document's ids and its end id are one piece, or, where longer than a sequence, pieces of the full
length behind a shorter first one. Each task packs its share of the pieces, longest first: with
N(g) open sequences of residual gap g, a piece goes where the sum of all N(g)**2 becomes smallest
(a tie: into the smallest gap, a new sequence last). That keeps gaps of all sizes at hand, so later
pieces close sequences exactly. At a task's end the pieces of the sequences that are still open are placed
anew in the same way, as long as that leaves fewer sequences: what the first pass spread over gaps of
all sizes for pieces that never came closes up.

Encoding runs where the texts are read; only a row of numbers per piece is shuffled. Tasks get
``PIECES_PER_TASK`` pieces each, so the share of unfilled ends doesn't depend on the input's size.

Defined cases: null text is an empty one: the end id alone. Null ids and repeated rows are packed
each as a document of its own. An empty table gives an empty result. Very long texts are encoded
whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.shipping import map_in_arrow, spread
from stemma.llm import tokens
from stemma.llm.common import materialize, table

LENGTH = 1024
END_ID = 2
PIECES_PER_TASK = 100_000
_NEVER = np.iinfo(np.int64).max
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((i, i + length) for i in range(first, n, length))]


class SumOfSquares:
    """Open sequences by residual gap; :meth:`place` gives the number of the sequence that a piece goes to."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.open: list[list[int]] = [[] for _ in range(length + 1)]
        self.n = np.zeros(length + 1, np.int64)
        self.made = 0

    def place(self, size: int) -> int:
        n, length = self.n, self.length
        # change of the sum of squares: gap g loses one, gap g - size gains one, if it isn't 0
        change = 1 - 2 * n[size:length]
        change[1:] += 2 * n[1 : length - size] + 1
        change[n[size:length] == 0] = _NEVER
        best = int(change.argmin()) if size < length else -1
        fresh = 2 * n[length - size] + 1 if size < length else 0
        if best < 0 or fresh < change[best]:
            where, gap = self.made, length
            self.made += 1
        else:
            gap = best + size
            where = self.open[gap].pop()
            n[gap] -= 1
        if gap > size:
            self.open[gap - size].append(where)
            n[gap - size] += 1
        return where


def pack(sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Sequence number of each piece; ``sizes`` should fall."""
    at = np.empty(len(sizes), np.int64)
    rows, closed, before = np.arange(len(sizes)), 0, math.inf
    while True:
        bins = SumOfSquares(length)
        where = np.fromiter((bins.place(s) for s in sizes[rows].tolist()), np.int64, len(rows))
        if bins.made >= before:
            return at
        at[rows] = where + closed
        full = np.bincount(where, weights=sizes[rows], minlength=bins.made) == length
        number = np.where(full, np.cumsum(full) - 1, int(full.sum()) + np.cumsum(~full) - 1)
        at[rows] = number[where] + closed
        rows, closed, before = rows[~full[where]], closed + int(full.sum()), int((~full).sum())
        if not len(rows):
            return at


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    path = tokenizer or tokens.default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for b in tokens.slices(whole, 1):
                rows, parts = [], []
                for doc, x in zip(b.column(0).to_pylist(), tokens.encode(path, b.column(1).to_pylist()), strict=True):
                    x = np.concatenate([x, end])
                    for k, (i, j) in enumerate(cuts(len(x), length)):
                        rows.append((doc, k, i, j - i, tokens.crc(x[i:j])))
                        if ids:
                            parts.append(x[i:j])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if ids:
                    cols, names = [*cols, tokens.id_lists(parts)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return spread(docs.select("doc_id", "text")).transform(map_in_arrow, run, _PIECES + (", ids array<int>" if ids else ""))


def sequences(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``parts`` with sequence_id and offset; ``parts`` should be materialised, as it is read twice."""
    per_task = PIECES_PER_TASK // 5 if "ids" in parts.columns else PIECES_PER_TASK  # a task holds its rows in memory
    n = max(1, math.ceil(parts.count() / per_task))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    at = parts.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        sizes = t.column(at).to_numpy()
        where = pack(sizes, length)
        order = np.argsort(where, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        firsts = np.r_[True, np.diff(where[order]) != 0]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = run - np.repeat(run[firsts], np.diff(np.r_[np.flatnonzero(firsts), len(sizes)]))
        base = TaskContext.get().partitionId() << 40
        t = t.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=10_000)

    # round robin: even tasks, however often a row repeats
    dealt = parts.repartition(n).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.transform(map_in_arrow, run, f"{schema}, sequence_id long, offset long")


def apply(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, ids: bool = False) -> DataFrame:
    """All pieces of all documents with their places; ``ids`` adds the token ids."""
    return sequences(materialize(pieces(docs, tokenizer, end_id, length, ids), "pieces"), length)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: place and checksum of every piece."""
    return apply(table(spark, sf_dir, "documents"))
