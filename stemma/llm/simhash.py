"""SimHash near-duplicates by multi-index hashing.

Fingerprints that are equal are one class from the start, so a text that is copied a million times
is one row below. A fingerprint is cut into ``SEGMENTS``; two that differ in 4 bits or fewer agree in
one segment up to that segment's radius (the radii plus one sum to five). Each class goes into the
tables' buckets of its own segment values and of all values in the small Hamming balls around
them; of a ball of radius 1 the values with one bit more are enough, as the partner has the other
half. All members of a bucket are compared over the whole 64 bits.

A bucket of more than ``REFINE`` members is indexed anew over the other segments, within the bucket:
two members differ there by 2 bits or fewer in one segment or by one in the other, and fingerprints at
2 bits share a value at one bit from both. A bucket of more than ``BLOCK`` members is dealt into
blocks, and each pair of blocks is compared in a task of its own. So no bucket meets in one task, and
no size of bucket makes the work grow with its square before the bits run out. A comparison hands on a spanning forest of its
links, never all pairs. Components come from :func:`graph.components`.

Defined cases: null, empty and blank texts have the fingerprint zero and link like any other. Fewer
than four words are one shingle. Rows with a null id get their fingerprint, take no part in linking,
and have a null component. Repeated ids are one node. An empty table gives an empty result. Texts are
read whole, shingles in runs of bounded size. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions.shipping import map_in_arrow, spread
from stemma.llm import graph
from stemma.llm.common import materialize, table

WORDS = 4
SEED = 42
BITS = 4
#: Lowest bit, width and radius of each segment.
SEGMENTS = ((42, 22, 1), (21, 21, 1), (0, 21, 0))
BLOCK, REFINE = 512, 8192
#: Up to so many large buckets (16 bytes each) are broadcast; more are joined.
BROADCAST_ROWS = 100_000
RUN = 100_000
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """SimHash of a text's word shingles, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, ends[:-1] + 1]
    k = min(WORDS, len(words))
    first, last = first[: len(words) - k + 1], ends[k - 1 :]
    votes = np.zeros((8, 8), np.int64)
    column = np.arange(8) * 256
    for i in range(0, len(first), RUN):
        parts = [joined[x:y] for x, y in zip(first[i : i + RUN].tolist(), last[i : i + RUN].tolist(), strict=True)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.bincount((octets + column).ravel(), minlength=2048).reshape(8, 256) @ _BIT
    bits = (2 * votes.ravel() > len(first)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return spread(docs.select("doc_id", "text")).transform(map_in_arrow, run, "doc_id long, fp long")


def _buckets(fp: Column) -> Column:
    """Array of the buckets that a fingerprint is a member of, each as one long."""
    def of(segment: int, low: int, width: int, radius: int) -> Column:
        key = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        keys = F.array(key)
        if radius:
            bits = F.sequence(F.lit(0), F.lit(width - 1))
            ball = F.transform(bits, lambda i: key.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
            keys = F.concat(keys, F.filter(ball, lambda x: x != key))
        return F.transform(keys, lambda x: x.bitwiseOR(F.lit(segment << 32)))

    return F.concat(*[of(k, *segment) for k, segment in enumerate(SEGMENTS)])


def _refined(bucket: Column, fp: Column) -> Column:
    """Array of the finer buckets of a member of a large bucket.

    In the bucket's own segment members agree or differ by one bit, so ``BITS`` bits at most are left
    for the other two; ball sizes 2 and 1 again make up five. A bucket's name is hashed from its parts:
    if two share one, their members are compared in vain, no more.
    """
    home = F.shiftright(bucket, 32)

    def of(segment: int) -> Column:
        low, width, _ = SEGMENTS[segment]
        key = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        ball = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: key.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        wide = home != F.lit((segment + 1) % len(SEGMENTS))  # of the two others, one takes the ball of 2
        keys = F.concat(F.array(key), F.when(wide, ball).otherwise(F.filter(ball, lambda x: x > key)))
        return F.when(home != segment, F.transform(keys, lambda x: F.xxhash64(bucket, F.lit(segment), x))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*[of(k) for k in range(len(SEGMENTS))])


def _sizes(members: DataFrame, least: int, name: str) -> DataFrame:
    """(l_bucket, n) of the buckets of more than ``least`` members; broadcast if few."""
    large = members.groupBy("bucket").count().where(F.col("count") > least)
    large = materialize(large.select(F.col("bucket").alias("l_bucket"), F.col("count").alias("n")), name)
    return F.broadcast(large) if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else large


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links inside each (bucket, i, j); the rows come sorted by these."""
    held: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray]) -> pa.RecordBatch | None:
        bucket, i, j, fp, node = cols
        fp = fp.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
        n = len(bucket)
        same = (bucket[1:] == bucket[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
        group = np.cumsum(np.r_[0, ~same]) if n else bucket
        end = np.searchsorted(group, group, side="right")
        at, a, b, size, d = np.arange(n), [], [], 0, 1
        label = np.arange(n)

        def settle() -> None:
            nonlocal label, size
            x, y = label[np.concatenate(a)], label[np.concatenate(b)]
            label = graph.local_labels(n, x, y)[label]
            a.clear(), b.clear()
            size = 0

        while True:
            at = at[at + d < end[at]]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= BITS]
            if len(near):
                a.append(near)
                b.append(near + d)
                size += len(near)
                if size > 1_000_000:
                    settle()
            d += 1
        if size:
            settle()
        x, y = node, node[label]
        out = x != y
        if not out.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(x[out]), pa.array(y[out])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut and (out := links([c[:cut] for c in cols])) is not None:
            yield out
    if held is not None and (out := links(held)) is not None:
        yield out


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component) of every distinct fingerprint; ``fps`` (doc_id, fp) should be materialised."""
    spark = fps.sparkSession
    own = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    own = materialize(own, "classes")
    members = own.select(F.explode(_buckets(F.col("fp"))).alias("bucket"), "fp", "node")
    large = _sizes(members, BLOCK, "large")
    sized = members.join(large, F.col("bucket") == F.col("l_bucket"), "left").withColumn("n", F.coalesce("n", F.lit(1)))
    if large.where(F.col("n") > REFINE).limit(1).count():
        fine = sized.where(F.col("n") > REFINE).select(F.explode(_refined(F.col("bucket"), F.col("fp"))).alias("bucket"), "fp", "node")
        again = _sizes(fine, BLOCK, "larger").withColumnRenamed("l_bucket", "f_bucket")
        fine = fine.join(again, F.col("bucket") == F.col("f_bucket"), "left").select("bucket", "fp", "node", F.coalesce("n", F.lit(1)).alias("n"))
        sized = sized.where(F.col("n") <= REFINE).select("bucket", "fp", "node", "n").unionByName(fine)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "node")
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = dealt.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").transform(map_in_arrow, _compare, "a long, b long")
    found = graph.components(links)
    joined = own.join(found.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left")
    return joined.select("fp", F.coalesce("component", "node").alias("component"))


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    A fingerprint may have a third of all rows; adaptive execution splits its side of the last join.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    found = materialize(classes(fps), "components").withColumnRenamed("fp", "c_fp")
    out = fps.join(found, F.col("fp") == F.col("c_fp"), "left")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component, that of the smallest id; rows without an id stay.

    Of repeated rows of that id the one with the smallest text hash stays.
    """
    keep = apply(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__sh_id")).distinct()
    named = docs.where("doc_id is not null").join(keep, F.col("doc_id") == F.col("__sh_id"), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    one = named.withColumn("__sh_n", first).where("__sh_n = 1").select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest: fingerprint and component of every document."""
    return apply(table(spark, sf_dir, "documents"))
