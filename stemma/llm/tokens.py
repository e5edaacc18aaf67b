"""Token ids as Parquet files that can be read by part.

Documents are range-partitioned by id, sorted, encoded and written by Spark's own Parquet writer,
so any store that Spark writes to will do. A row holds the id, the number of tokens and the list of
token ids. Writer version 2 with dictionaries for the token lists (delta encoding for the id and
count columns, whose values are nearly all distinct), small row groups and short pages with page
indexes: a reader of counts touches no token page, and one of a few documents finds their pages by
the id column's index.

Defined cases: null text is an empty one and has the end id alone. Null ids sort first. Repeated ids
sort by the text's hash. An empty table gives an empty result. Very long texts are encoded whole.
Special tokens' strings in a text are ordinary text. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.shipping import map_in_arrow
from stemma.llm.common import materialize, table

END_ID = 0
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 500
PAGE_BYTES = 256 << 10


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def load(path: str):
    """The tokenizer of a file on this machine; one for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    return made


def plain_byte_level(made: dict) -> bool:
    """Whether a tokenizer file's content is a byte-level BPE that :class:`Pieces` may split by itself.

    That is, its pre-tokenizer is the byte-level split without a prefix blank, nothing normalises or matches before it, and merges are
    the same every time.
    """
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    return (
        made.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("add_prefix_space") is False
        and split.get("use_regex", True) is True
        and all(t.get("special") for t in made.get("added_tokens") or ())
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
    )


class Pieces(dict):
    """Ids by pre-token, each encoded once by the tokenizers library and then looked up.

    A byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens in
    turn. The split below is the byte-level one for code points under 256, where the classes of
    letters and numbers can be listed; a text with any other code point is encoded whole. When
    ``MOST`` pre-tokens are held, the store starts anew.
    """

    MOST = 1_000_000
    LETTER, NUMBER, BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
    SPLIT = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
    )

    def __init__(self, path: str):
        super().__init__()
        self.tok = load(path)
        self.splits = plain_byte_level(json.loads(self.tok.to_str()))

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array("I", self.tok.encode(piece, add_special_tokens=False).ids).tobytes()
        return ids

    def encode(self, text: str) -> np.ndarray:
        try:
            plain = self.splits and text.encode("latin-1") is not None
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        if len(self) > self.MOST:
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, self.SPLIT.findall(text))), np.uint32)


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(path: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text as uint32, without special tokens."""
    pieces = _pieces(path)
    for t in texts:
        yield pieces.encode(t or "")


def id_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Arrow list<int32> of id arrays."""
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def slices(b: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of a text column, a row at least, which bounds memory."""
    size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if j > i:
            yield b.slice(i, j - i)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, tokens) of each row, in the rows' order; ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for whole in batches:
            for b in slices(whole, 1):
                ids = [np.concatenate([x, end]) for x in encode(tokenizer, b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(x) for x in ids], pa.int64()), id_lists(ids)],
                    names=["doc_id", "n_tokens", "tokens"],
                )

    return docs.select("doc_id", "text").transform(map_in_arrow, run, "doc_id long, n_tokens long, tokens array<int>")


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write all token lists in ascending doc_id order to ``path``; a DataFrame over the files.

    Without a path they go to the shared folder and are removed when the Python process ends.
    The only shuffle is the range partitioning of the texts, so encoding is spread by text volume
    and runs once. Ranges are of id and text hash, so null or repeated ids don't meet in one task.
    """
    n = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    lists = encoded(ordered, tokenizer or default_tokenizer(), end_id)
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    if path is None:
        return materialize(lists, "tokens", **options)
    lists.write.options(**options).parquet(path)
    return read(docs.sparkSession, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, tokens) of files that :func:`write` made."""
    return spark.read.schema("doc_id long, n_tokens long, tokens array<int>").parquet(path)


def select(files: DataFrame, ids: list[int] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows of the given ids, or of the ids from ``low`` up to ``high``.

    The filter is on the column that the files are sorted by and reaches the scan: files and row groups without such ids are skipped by
    their statistics, pages by the column index.
    """
    out = files
    if ids is not None:
        out = out.where(F.col("doc_id").isin([int(i) for i in ids]))
    if low is not None:
        out = out.where(F.col("doc_id") >= int(low))
    if high is not None:
        out = out.where(F.col("doc_id") < int(high))
    return out


def counts(files: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): no token page is read."""
    return files.select("doc_id", "n_tokens")


def starts(files: DataFrame, value: str = "n_tokens") -> DataFrame:
    """(doc_id, n_tokens, start, file, row) from the files' counts alone; no token page is read.

    Running sums are taken file by file and offset by the files before it, one row per file.
    """
    rows = files.select("doc_id", value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    per = rows.groupBy("file").agg(F.sum(value).alias("n"))
    order = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("file").alias("o_file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    run = F.sum(value).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("run", run).join(offsets, F.col("file") == F.col("o_file"))
    return joined.select("doc_id", value, (F.col("offset") + F.col("run") - F.col(value)).alias("start"), "file", "row")


def digests(files: DataFrame) -> DataFrame:
    """(file, row, n_tokens, ids_crc32) computed from the token lists in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            crcs = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], names=["file", "row", "crc"])

    seen = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "tokens")
    return seen.transform(map_in_arrow, run, "file string, row long, crc long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest, all of it from the written files."""
    files = write(table(spark, sf_dir, "documents"))
    crcs = digests(files).withColumnsRenamed({"file": "c_file", "row": "c_row"})
    at = starts(files)
    joined = at.join(crcs, (F.col("file") == F.col("c_file")) & (F.col("row") == F.col("c_row")))
    return joined.select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))

