"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics come from arrays of code points, many documents at once. Trees are grown on the driver
from at most about ``SAMPLE`` labelled rows (chosen by a hash of the id among those that
:func:`common.held_out` leaves for learning): values become at most ``BINS`` bins by quantiles,
gradients are summed per bin, and a split is the bin edge with the largest gain. All trees are
complete and lie in three flat arrays, so a batch walks all trees at once, level by level.

Defined cases: null and empty texts get the statistics of no text and a score like any other. No
labelled rows: all scores 0.5. Several labels of one id: the lowest counts, of several texts the one of the least hash. Null or repeated ids are
scored each for itself. An empty table gives an empty result. Long texts are read in pieces, but words,
lines and repeats are those of the whole text.
Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.shipping import map_in_arrow, spread
from stemma.llm import codepoints
from stemma.llm.common import held_out, table

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 100, 4, 64, 0.15, 10, 1.0
SYMBOLS = "#*$%&|<>"
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "symbols", "bars", "exclaims", "stops",
    "other_marks", "non_ascii", "blank", "log_lines", "line_words", "dup_lines", "distinct_words", "repeat_pairs",
    "repeat_threes", "short_words", "capital_words",
)


def _by(part: np.ndarray, n: int, where: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(part if where is None else part[where], minlength=n).astype(float)


def _repeats(part: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per part: distinct keys, and keys that occur more than once, each time counted."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    s = np.sort((part.astype(np.uint64) << np.uint64(42)) | (key >> np.uint64(22)))
    new = np.r_[True, s[1:] != s[:-1]]
    lone = new & np.r_[new[1:], True]
    at = (s >> np.uint64(42)).astype(np.int64)
    return _by(at, n, new), _by(at, n, ~lone)


def _runs(cp: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of the runs where ``inside`` holds; it must not hold at the end."""
    start, length, h = _sums(cp, inside)
    return start, length, _hash(h)


def _hash(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93)


def _sums(cp: np.ndarray, inside: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with their hashes as sums over characters; the first run has ``before`` characters ahead of this piece."""
    edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    length = end - start
    pos = np.arange(len(cp), dtype=np.uint64)
    begun = np.zeros(len(cp), np.uint64)
    begun[start] = np.diff(np.r_[0, start]).astype(np.uint64)
    nth = pos - np.cumsum(begun)
    if before:
        nth[: length[0]] += np.uint64(before)
    mixed = (cp.astype(np.uint64) + np.uint64(1)) * (nth * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed[~inside] = 0
    return start, length, np.add.reduceat(mixed, start)


def _word_repeats(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per part: distinct words, repeated pairs and repeated triples of words."""
    distinct, _ = _repeats(of, h, n)
    same2, same3 = of[1:] == of[:-1], of[2:] == of[:-2]
    pair = h[:-1] * np.uint64(3) + (h[1:] ^ np.uint64(0x5851F42D4C957F2D)) if len(h) > 1 else h[:0]
    three = pair[:-1] * np.uint64(5) + h[2:] if len(h) > 2 else h[:0]
    _, pairs = _repeats(of[:-1][same2], pair[same2] * np.uint64(_ODD), n)
    _, threes = _repeats(of[:-2][same3], three[same3] * np.uint64(_ODD), n)
    return distinct, pairs, threes


def _joined(pieces: list[str], inside_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first code point, length, hash) of the runs of a text in pieces; a run may go on over cuts."""
    firsts, lengths, sums = [], [], []
    goes_on = False
    for piece in pieces:
        cp, _ = codepoints.points([piece])
        inside = inside_of(cp)
        joins = goes_on and inside[0]
        start, length, h = _sums(cp, inside, int(lengths[-1][-1]) if joins else 0)
        first = cp[start]
        if joins:
            lengths[-1][-1] += length[0]
            sums[-1][-1:] += h[:1]
            first, length, h = first[1:], length[1:], h[1:]
        if len(h):
            firsts.append(first)
            lengths.append(length)
            sums.append(h)
        goes_on = bool(inside[-2])  # the last is the line feed after the piece
    if not sums:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lengths), _hash(np.concatenate(sums))


def _long_counts(text: str) -> np.ndarray:
    """Counts of a text longer than a piece: characters by pieces, words and lines and their repeats over the whole."""
    pieces = [text[k : k + codepoints.PIECE] for k in range(0, len(text), codepoints.PIECE)]
    c = sum(_counts([p])[:, 0] for p in pieces)
    first, length, h = _joined(pieces, lambda cp: ~((cp == 32) | ((cp >= 9) & (cp <= 13))))
    upper = ((first >= 65) & (first <= 90)) | ((first >= 0xC0) & (first <= 0xDE))
    _, _, l_h = _joined(pieces, lambda cp: cp != 10)
    l_distinct, _ = _repeats(np.zeros(len(l_h), np.int64), l_h, 1)
    repeats = _word_repeats(np.zeros(len(h), np.int64), h, 1)
    c[1:4] = len(h), length.sum(), length.max(initial=0)
    c[13:] = len(l_h), len(l_h) - l_distinct[0], *(x[0] for x in repeats), (length <= 3).sum(), upper.sum()
    return c


def _counts(parts: list[str]) -> np.ndarray:
    """Additive counts per part; :func:`statistics` makes ratios of them."""
    n = len(parts)
    cp, starts = codepoints.points(parts)
    part = np.repeat(np.arange(n), np.diff(starts))
    blank = (cp == 32) | ((cp >= 9) & (cp <= 13))
    letter = codepoints.letters()[cp]
    upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE))
    digit = (cp >= 48) & (cp <= 57)
    mark = ~(blank | letter | digit)
    symbol = np.isin(cp, np.frombuffer(SYMBOLS.encode("utf-32-le"), np.uint32))
    at, length, h = _runs(cp, ~blank)
    of = part[at]
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    distinct, pairs, threes = _word_repeats(of, h, n)
    l_at, _, l_h = _runs(cp, cp != 10)
    lines, (l_distinct, _) = _by(part[l_at], n), _repeats(part[l_at], l_h, n)
    return np.stack(
        [
            np.diff(starts) - 1.0, _by(of, n), np.bincount(of, length, n), longest, _by(part, n, upper), _by(part, n, digit),
            _by(part, n, symbol), _by(part, n, cp == ord("|")), _by(part, n, cp == ord("!")), _by(part, n, cp == ord(".")),
            _by(part, n, mark), _by(part, n, cp > 127), _by(part, n, blank) - 1, lines, lines - l_distinct, distinct, pairs, threes,
            _by(of, n, length <= 3), _by(of, n, upper[at]),
        ]
    )


_ODD = 0x9FB21C651E98DF25


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    c = np.zeros((20, len(texts)))
    long = [i for i, t in enumerate(texts) if t and len(t) > codepoints.PIECE]
    for at, parts in codepoints.chunks([None if t and len(t) > codepoints.PIECE else t for t in texts]):
        c[:, at] = _counts(parts)
    for i in long:
        c[:, i] = _long_counts(texts[i])
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    chars, n_words, lines = c[0], c[1], c[13]
    return np.stack(
        [
            np.log1p(chars), np.log1p(n_words), over(c[2], n_words), c[3], over(c[4], chars), over(c[5], chars), over(c[6], chars),
            over(c[7], n_words), over(c[8], n_words), over(c[9], n_words), over(c[10], chars), over(c[11], chars), over(c[12], chars),
            np.log1p(lines), over(n_words, lines), over(c[14], lines), over(c[15], n_words), over(c[16], n_words), over(c[17], n_words),
            over(c[18], n_words), over(c[19], n_words),
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Complete trees in flat arrays: node k's children are 2k + 1 and 2k + 2."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        tree = np.arange(trees)
        for i in range(0, len(x), 2000):
            part = x[i : i + 2000]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.edge[tree, node])
            total[i : i + 2000] += self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees by histograms of gradients and Hessians of the logistic loss."""
    inner = (1 << DEPTH) - 1
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)), float(np.log(p / (1 - p))))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    feature, edge = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    shift = np.arange(width) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * BINS) + shift + binned).ravel()
            size = n * width * BINS
            g, h, c = (
                np.bincount(key, np.repeat(v, width), size).reshape(n, width, BINS).cumsum(axis=2)
                for v in (grad, hess, np.ones(len(y)))
            )
            tg, th, tc = g[..., -1:], h[..., -1:], c[..., -1:]
            gain = g**2 / (h + L2) + (tg - g) ** 2 / (th - h + L2) - tg**2 / (th + L2)
            gain[(c < LEAST) | (tc - c < LEAST)] = -1
            best = gain.reshape(n, -1).argmax(axis=1)
            for k in range(n):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], edge[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > edge[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, inner + 1), np.bincount(at, hess, inner + 1)
        leaf[t] = -RATE * g / (h + L2)
        margin += leaf[t, at]
    return Forest(feature, edge, leaf, base)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees from a bounded sample of labelled documents; ``labels`` has doc_id and quality."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    n = usable.count()
    limit = min(1 << 20, (sample << 20) // max(n, 1) + 1)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit)
    chosen = chosen.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                names=["y", "x"],
            )

    # the sample is bounded by its parameter (16 bytes a row), so it may be broadcast
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("l_id", F.col("y").cast("int").alias("y"), "text")
    # one text an id, however often the id repeats
    rows = rows.groupBy("l_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).select("y", "text")
    got = rows.transform(map_in_arrow, run, "y int, x array<double>").toPandas()
    if not len(got):
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    y = got["y"].to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # the same trees whatever order the rows came in
    return grow(x[order], y[order])


def apply(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(forest)  # 100 trees of 31 nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = held.value.score(statistics(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return spread(docs.select("doc_id", "text")).transform(map_in_arrow, run, "doc_id long, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: score of every document."""
    docs = table(spark, sf_dir, "documents")
    forest = learn(docs, table(spark, sf_dir, "labels"))
    return apply(docs, forest).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
