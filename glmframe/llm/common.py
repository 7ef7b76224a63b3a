"""Shared helpers of the training-data operators: words, blocks, components."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glmframe.session import ensure_checkpoint_dir

#: Bytes that separate words: space and 0x09-0x0D; every other byte belongs to one.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multiplier of the polynomial hashes modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; doubles its length per step."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Powers:
    """Power tables of the base and its inverse, grown on demand per worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up, self.down


_POWERS = _Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every bit of the sum."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans values[start:end] from one prefix sum (Rabin-Karp modulo 2**64)."""
    up, down = _POWERS.get(len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts])


#: Bytes whose prefix sums are held at a time (one longer word makes a stretch of its own).
_STRETCH = 1 << 18


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes; a word's hash doesn't depend on its place, so stretches are taken one by one."""
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _STRETCH, side="right")))
        values = np.add(raw[a : ends[j - 1]], np.uint64(1), dtype=np.uint64)
        out[i:j] = span_hashes(values, starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def words_of(texts: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of UTF-8 texts: starts, ends (in the joined buffer), hashes, first word of each text.

    The buffer is the texts, each followed by one newline.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    hashes = _word_hashes(raw, starts, ends)
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return starts, ends, hashes, np.searchsorted(starts, at)


def slices(texts: Sequence[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes (one long text makes a range of its own)."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; a null is an empty text."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = "8m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session sends small batches, so long texts don't add up in a worker.

    A session that was started with a bound of its own keeps it.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH_CONF):
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    return df


#: Keys with more than this share's inverse of all rows are joined by broadcast; there are fewer than so many.
HOT_KEYS = 1000


def join_repeated(rows: DataFrame, found: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows with a key of ``found``, whose ``n`` is the key's number of rows among ``total``; common keys by broadcast.

    So a key that a third of all rows have doesn't gather them in one task.
    """
    hot = F.broadcast(found.where(F.col("n") > F.lit(max(1, total // HOT_KEYS))).drop("n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(found.drop("n"), keys)
    return rows.join(hot, keys).unionByName(rest)


def with_row(rows: DataFrame, results: str) -> T.StructType:
    """Schema of ``row``, as it is in ``rows`` (any column names), followed by the ``results``."""
    return T.StructType([T.StructField("row", rows.schema["row"].dataType), *T.StructType.fromDDL(results).fields])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_blocks(df: DataFrame, id_col: str, blocks: int) -> Column:
    """Block number (0 .. blocks - 1) of a row by ascending id; null ids are in block 0.

    The bounds are quantiles of the id column (one job over that column alone);
    each row finds its block by a binary search over them, so equal ids always
    meet in one block and blocks are in the order of the ids.
    """
    if blocks < 2:
        return F.lit(0)
    probs = [i / blocks for i in range(1, blocks)]
    found = df.agg(F.percentile_approx(F.col(id_col), probs, max(10_000, 20 * blocks)).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))))
    # get() is null beyond the end, and a null bound is never passed
    found_at = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) < F.col(id_col), at + step).otherwise(at),
    )
    return F.coalesce(found_at, F.lit(0))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); component is the smallest node.

    Alternates large-star and small-star steps: every node points to the
    smallest of its neighbours until nothing changes. Minima are partial
    aggregates and hub nodes are joined (AQE splits them), so no
    neighbourhood is ever gathered; every round is checkpointed.
    """
    now = checkpointed(edges.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    # a star now: every node points to the smallest node of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
