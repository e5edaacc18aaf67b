"""Language identification with language-bitmask n-gram filters.

A model is one bit-sliced Bloom filter: every cell holds a bit per language (in as many words of up
to 64 bits as there are languages for), so the ``HASHES`` cells
of an n-gram, ANDed, give the languages whose profile has it. The n-grams are runs of four lower-case
letters, of which the first and last may be a word's edge. A language's count for a text is the
number of n-grams with its bit; a filter whose cells are set to a share f has f**HASHES false hits,
so the count is corrected as (hits - n * f**HASHES) / (1 - f**HASHES). The largest count decides;
the score is its share of all languages' counts.

Profiles are learnt from a sample of at most about ``SAMPLE`` documents a language, chosen by a hash
of id and text, among those that :func:`common.held_out` leaves for learning; rows that repeat come once. A language has an n-gram
if it occurs ``LEAST`` times or more in its sample, at ``SHARE`` or more of the highest rate that
any language has; that keeps foreign passages out of profiles.
Every language is learnt, however many there are.

Defined cases: null text, or text without a letter, is ``und`` with score 0. Letters but no known
n-gram: the most frequent language, score 0. Nothing to learn from: all ``und``. Null or repeated
ids are predicted each for itself. An empty table gives an empty result. Long texts are read whole, in pieces that
change no n-gram. Columns other than doc_id, text and lang are not read, whatever their names.
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
from stemma.llm.common import held_out, materialize, table

SAMPLE = 2000
LEAST = 3
SHARE = 0.1
#: Languages per word of a cell.
WORD = 64
HASHES = 3
#: Cells per n-gram of the largest profile, rounded up to a power of two.
CELLS = 16
#: Of a text's n-grams, the share that the predicted language must know for the pipeline to keep it.
KNOWN = 0.2
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def grams(parts: list[str], low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, number of the part that it is in, letters per part) of lower-case texts.

    Of a single part, n-grams whose second character, and letters, that lie from ``low`` up to ``high``.
    """
    cp, starts = codepoints.points(parts)
    letter = codepoints.letters()[cp]
    c = np.where(letter, cp, 32).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), np.diff(starts))
    n_letters = np.bincount(part[low:high][letter[low:high]], minlength=len(parts))
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    padded = np.concatenate([[np.uint64(32)], c])  # the first word's edge
    at = np.flatnonzero(letter[:-2] & letter[1:-1])  # windows whose inner two are letters, by the first of these
    if low or high is not None:
        at = at[(at >= low) & (at < (len(c) if high is None else high))]
    h = padded[at]
    for k in (1, 2, 3):
        h = h * np.uint64(0x100000001B3) + padded[at + k] * np.uint64(0x9E3779B1)
    h ^= h >> np.uint64(29)
    return h, part[at], n_letters


def runs(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, hashes, part of each, letters per part) of all texts.

    A text longer than a piece is cut, each piece with the characters around it that its n-grams reach; so the n-grams are
    those of the whole text.
    """
    for at, parts in codepoints.chunks([(t or "").lower() for t in texts]):
        if len(parts) > 1 or len(parts[0]) <= codepoints.PIECE:
            yield (at, *grams(parts))
            continue
        text, size = parts[0], codepoints.PIECE
        for start in range(0, len(text), size):
            lead = min(start, 1)
            end = min(len(text), start + size)
            yield (at, *grams([text[start - lead : end + 2]], lead, lead + end - start))


@dataclass
class Model:
    languages: list[str]
    cells: np.ndarray
    bits: int
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], profiles: list[np.ndarray]) -> Model:
        largest = max([1, *map(len, profiles)])
        bits = max(10, int(np.ceil(np.log2(largest * CELLS))))
        kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint64
        cells = np.zeros((1 << bits, max(1, -(-len(languages) // WORD))), kind)
        for i, profile in enumerate(profiles):
            for k in range(HASHES):
                at = cls.places(profile, k, bits)
                cells[at, i // WORD] |= kind(1 << i % WORD)
        fill = np.array([((cells[:, i // WORD] >> kind(i % WORD)) & kind(1)).mean() for i in range(len(languages))])
        return cls(languages, cells, bits, fill**HASHES)

    @staticmethod
    def places(h: np.ndarray, k: int, bits: int) -> np.ndarray:
        return (h * np.uint64(_MIX[k])) >> np.uint64(64 - bits)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: corrected count of each language, number of n-grams, number of letters."""
        hits = np.zeros((len(texts), len(self.languages)))
        n, n_letters = np.zeros(len(texts)), np.zeros(len(texts))
        kind = self.cells.dtype.type
        for at, h, part, letters in runs(texts):
            places = [self.places(h, k, self.bits) for k in range(HASHES)]
            np.add.at(n, at, np.bincount(part, minlength=len(at)))
            np.add.at(n_letters, at, letters)
            for i in range(len(self.languages)):
                if i % WORD == 0:
                    mask = np.bitwise_and.reduce([self.cells[:, i // WORD][p] for p in places])
                found = part[(mask & kind(1 << i % WORD)) != 0]
                np.add.at(hits[:, i], at, np.bincount(found, minlength=len(at)))
        fixed = (hits - n[:, None] * self.false_rate) / (1 - self.false_rate)
        return np.clip(fixed, 0, None), n, n_letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Per text: language, score, share of its n-grams that the language knows."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts, n, letters = self.counts(texts)
        best = counts.argmax(axis=1) if len(texts) else np.zeros(0, int)
        top, total = counts[np.arange(len(texts)), best], counts.sum(axis=1)
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        known = np.clip(np.divide(top, n, out=np.zeros(len(texts)), where=n > 0), 0, 1)
        blank = letters == 0
        names = ["und" if b else self.languages[i] for i, b in zip(best, blank, strict=True)]
        return names, np.where(blank, 0.0, score), np.where(blank, 0.0, known)


def sampled(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[str]]:
    """(lang, text) of about ``sample`` different documents a language at most; all languages, the most frequent first.

    Rows are chosen by a hash of id and text, so neither null nor repeated ids bring in more, and repeated rows come once.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    counted = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counted:
        return usable.select("lang", "text"), []
    # the least 2**-20 parts of the hash, by language: about ``sample`` documents of each
    limit = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1 << 20, (sample << 20) // r["count"] + 1))])
    h = F.xxhash64("doc_id", "text")
    chosen = usable.withColumn("h", h).where(F.pmod("h", F.lit(1 << 20)) < limit[F.col("lang")])
    return chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text"), [r["lang"] for r in counted]


def profiles(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Sorted hashes of the n-grams of each language, the most frequent first; only they reach the driver."""
    chosen, languages = sampled(docs, sample)
    if not languages:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(names)):
                for _, h, _, _ in runs([t for n, t in zip(names, texts, strict=True) if n == lang]):
                    h, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())],
                        names=["lang", "gram", "n"],
                    )

    counts = chosen.transform(map_in_arrow, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    if not totals:
        return {lang: np.zeros(0, np.uint64) for lang in languages}
    total = F.create_map(*[F.lit(x) for kv in totals.items() for x in kv])
    rated = counts.withColumn("rate", F.col("n") / total[F.col("lang")])
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("own"))  # a row a language at most
    got = top.select("gram", "top", F.inline("own")).where((F.col("n") >= LEAST) & (F.col("rate") >= SHARE * F.col("top"))).select("lang", "gram").toPandas()
    own = {name: np.sort(x.to_numpy().view(np.uint64)) for name, x in got.groupby("lang")["gram"]}
    return {lang: own.get(lang, np.zeros(0, np.uint64)) for lang in languages}


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the text and lang of the documents that aren't held out."""
    own = profiles(docs, sample)
    if not own:
        return Model([], np.zeros(1, np.uint8), 0, np.zeros(0))
    return Model.build(list(own), list(own.values()))


def predictions(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score and known; ``docs`` has a column text."""
    kept = spread(docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("t")))
    held = docs.sparkSession.sparkContext.broadcast(model)  # cells: 16 to 32 an n-gram of the largest profile, of up to 8 bytes for each 64 languages
    fields = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, known = held.value.predict(b.column(b.num_columns - 1).to_pylist())
            cols = [*b.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(known)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "lang_pred", "score", "known"])

    out = kept.transform(map_in_arrow, run, f"{fields}, lang_pred string, score double, known double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "known")


def apply(docs: DataFrame) -> DataFrame:
    """The documents whose language is known: not ``und``, and at least ``KNOWN`` of the n-grams."""
    model = learn(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index("text")
        for b in batches:
            names, _, known = held.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([n != "und" and k >= KNOWN for n, k in zip(names, known, strict=True)], pa.bool_()))

    docs_columns = list(docs.columns)
    return spread(docs).transform(map_in_arrow, run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = predictions(docs, learn(docs), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "known")
