"""Merkle dataset manifest (operator 13): a postorder append log.

Every row of a table becomes a leaf, a SHA-256 digest of its fields. The leaves
of a tree (here: of a source), in order, are the lowest level; while a level
has several nodes, every ``ARITY`` consecutive ones (the last run: fewer, even
one) become the digest of their digests joined as hex text. The roots of all
trees, in the order of their keys, are the leaves of one tree more.

1. ``ranked`` numbers the leaves of each tree: a range exchange on (tree, order,
   digest), so a tree with a third of all rows spreads over many tasks.
2. An aligned builder takes ``ARITY ** BLOCK_LEVELS`` consecutive leaves of one
   tree, which are a whole subtree, and appends every node to the log when it
   is complete: a node follows its last child. The blocks' roots are the
   leaves of the next round's blocks, until every tree has one block.
3. Where node i of level l of a tree is in that log follows from the sizes of
   the complete subtrees before it (``position``), without the log: no node
   holds a link. Proofs are read off the log at the closed-form positions of
   the siblings, block by block from the top down: a block's log meets one
   row, the proof of its root.

No task holds more than one block, whatever the size of a tree or the number
of trees; nothing but the range bounds, one row per partition and the number of
blocks reaches the driver.

Defined cases: a null field is ``-`` in a leaf, an empty text ``0:``; a null
tree key is a tree of its own, before all others; null order values come
first; equal order values are ordered by their digests, and equal rows are
leaves one after another; a lone leaf is its tree's root, and has an empty
proof; an empty table has no trees and no root. Other columns aren't read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glmframe.llm.common import bound_batches, checkpointed, shuffle_partitions
from glmframe.operators.row_index import with_row_index

ARITY = 3
#: A builder's subtree: ARITY ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 8
RANKED = "tree string, run long, slot long, place long, id long, other binary, digest binary"
LOG = "tree string, block long, level int, index long, leaves long, position long, root boolean, id long, other binary, digest binary"
PROVEN = (
    "tree string, index long, id long, other binary, digest binary, before array<binary>, after array<binary>, subroot binary"
)


# ------------------------------------------------------------- closed forms
def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


def position(level: int, index: int, leaves: int) -> int:
    """Place in its tree's log (from 0) of a node; ``leaves`` is the size of the tree, or of its
    first part up to the node's last leaf.

    Before a node stand those of its own level and below that end within it or
    further left, and all higher ones that end before its first leaf.
    """
    begin = index * ARITY**level
    end = min(begin + ARITY**level, leaves)
    at, size = -1, 1
    for j in range(level + 1):
        at += -(-end // size)
        size *= ARITY
    while size <= begin:
        at += begin // size
        size *= ARITY
    return at


def node_hash(children: Sequence[bytes]) -> bytes:
    """Digest of the children's digests, joined as lowercase hex text."""
    return sha256(b"".join(children).hex().encode()).digest()


# ------------------------------------------------------------------- leaves
def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (binary) of the fields, one after another: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    coded = []
    for f in fields:
        text = f.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*coded), 256))


def tree_key(column: Column) -> Column:
    """A text that sorts as the column does (bytewise, null first) and is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def ranked(leaves: DataFrame, partitions: int) -> DataFrame:
    """(tree, index, id, other, digest): ``index`` counts the leaves of a tree in the order of id and digest.

    ``leaves`` has (tree, id, other, digest). One range exchange, written once;
    only the tree that a partition begins with can have leaves in earlier
    ones, so one offset per partition is all that must be known besides.
    """
    order = ["tree", "id", "digest", "at"]
    dealt = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(partitions, *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, last, count, run = TaskContext.get().partitionId(), None, 0, -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # a run's rows stand together: its first row differs from the row before
            coded = batch.column("tree").dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            begins = first.copy()
            if names[codes[0]] == last:
                begins[0] = -count  # goes on
            else:
                run += 1
            places = np.arange(n) - np.repeat(begins, np.diff(first, append=n))
            runs = run + np.repeat(np.arange(len(first)), np.diff(first, append=n))
            last, count, run = names[codes[-1]], int(places[-1]) + 1, int(runs[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), pa.array(runs), pa.array(np.full(n, slot)), pa.array(places), batch.column("id"), batch.column("other"), batch.column("digest")],
                names=[x.split()[0] for x in RANKED.split(", ")],
            )

    numbered = checkpointed(dealt.sortWithinPartitions(*order).drop("at").mapInArrow(number, RANKED))
    ends = numbered.groupBy("slot", "run", "tree").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("tree").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition at most
    heads = ends.withColumn("offset", F.sum("n").over(before)).where("run = 0 and offset > 0").select("slot", "run", "offset")
    return numbered.join(F.broadcast(heads), ["slot", "run"], "left").select(
        "tree", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("index"), "id", "other", "digest"
    )


# ----------------------------------------------------------------- builders
class Builder:
    """Appends the entries of one aligned block, leaves or the roots of earlier blocks, and completes its subtree.

    ``log`` holds (level, index, leaves below, position, digest), complete nodes first.
    """

    def __init__(self, block: int, round_: int = 0, levels: int = BLOCK_LEVELS):
        self.base, self.levels = round_ * levels, levels
        self.first = block * ARITY ** (self.base + levels)
        self.entries = 0
        self.end = self.first  # leaves of the tree so far
        self.open: list[list[bytes]] = [[] for _ in range(levels + 1)]  # children that wait, per level
        self.log: list[tuple[int, int, int, int, bytes]] = []

    def _done(self, level: int, digest: bytes) -> None:
        level_, size = self.base + level, ARITY ** (self.base + level)
        index = (self.end - 1) // size
        self.log.append((level_, index, self.end - index * size, position(level_, index, self.end), digest))
        self.open[level].append(digest)

    def append(self, digest: bytes, leaves: int = 1) -> None:
        self.entries += 1
        self.end += leaves
        level = 0
        self._done(level, digest)
        while level < self.levels and len(self.open[level]) == ARITY:
            digest, self.open[level] = node_hash(self.open[level]), []
            level += 1
            self._done(level, digest)

    def close(self) -> None:
        """Completes the last runs: up to the block's root, or the tree's if that is lower."""
        for level in range(self.levels if self.first else height(self.entries)):
            if self.open[level]:
                digest, self.open[level] = node_hash(self.open[level]), []
                self._done(level + 1, digest)


def _table(columns: Sequence, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _build(round_: int, levels: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by("index")
        builder, places = Builder(block, round_, levels), []
        for digest, leaves in zip(table.column("digest").to_pylist(), table.column("leaves").to_pylist(), strict=True):
            places.append(len(builder.log))
            builder.append(digest, leaves)
        builder.close()
        n = len(builder.log)
        ids, others = [None] * n, [None] * n
        for at, doc, other in zip(places, table.column("id").to_pylist(), table.column("other").to_pylist(), strict=True):
            ids[at], others[at] = doc, other
        level, index, leaves, where, digests = zip(*builder.log, strict=True)
        root = [False] * (n - 1) + [True]
        return _table([[tree] * n, [block] * n, level, index, leaves, where, root, ids, others, digests], LOG)

    return run


def append_logs(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """The log, round by round: the last round has one block per tree.

    ``leaves`` has (tree, index, id, other, digest). The entries that a round
    begins with are the blocks' roots of the round before; all other nodes
    stand in the log once. Each round is written once.
    """
    rounds, now, size = [], leaves.withColumn("leaves", F.lit(1).cast("long")), ARITY**levels
    while True:
        aligned = now.withColumn("block", F.expr(f"index div {size}"))
        log = checkpointed(aligned.groupBy("tree", "block").applyInArrow(_build(len(rounds), levels), LOG))
        rounds.append(log)
        if not log.agg(F.max("block")).first()[0]:
            return rounds
        now = log.where("root").select("tree", F.col("block").alias("index"), "id", "other", "digest", "leaves")


def whole_log(rounds: list[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, position, level, index, digest) of every node once; ``position`` is dense in a tree."""
    parts = [
        log.where(F.col("level") > r * levels) if r else log for r, log in enumerate(rounds)
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.select("tree", "position", "level", "index", "digest")


def tree_roots(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree, from its last round."""
    return rounds[-1].where("root").select("tree", "digest")


# ------------------------------------------------------------------- proofs
_PROVEN = pa.schema(
    [("tree", pa.string()), ("index", pa.int64()), ("id", pa.int64()), ("other", pa.binary()), ("digest", pa.binary())]
    + [("before", pa.list_(pa.binary())), ("after", pa.list_(pa.binary())), ("subroot", pa.binary())]
)


def _prove(round_: int, levels: int):
    def run(key: tuple, log: pa.Table, above: pa.Table) -> pa.Table:
        base = round_ * levels
        entries = log.filter(pa.compute.equal(log.column("level"), base)).sort_by("index")
        if not entries.num_rows:
            return _PROVEN.empty_table()
        at = dict(zip(log.column("position").to_pylist(), log.column("digest").to_pylist(), strict=True))
        own = entries.column("index").to_pylist()
        end = own[-1] * ARITY**base + entries.column("leaves")[-1].as_py()
        top = max(log.column("level").to_pylist())
        rest = [above.column(c)[0].as_py() for c in ("before", "after")] if above.num_rows else [[], []]
        subroot = above.column("subroot")[0].as_py() if above.num_rows else None
        # the steps from a node upwards, a level at a time: all that is below a node shares them
        steps = {own[0] // ARITY ** (top - base): tuple(rest)}
        for level in range(top - 1, base - 1, -1):
            lower, count = {}, -(-end // ARITY**level)
            for parent, (before, after) in steps.items():
                run = range(parent * ARITY, min(parent * ARITY + ARITY, count))
                digests = [at[position(level, i, end)] for i in run]
                for k, i in enumerate(run):
                    lower[i] = [b"".join(digests[:k]), *before], [b"".join(digests[k + 1 :]), *after]
            steps = lower
        rows = [steps[i] for i in own]
        cuts = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
        sides = [pa.ListArray.from_arrays(cuts, pa.array([x for r in rows for x in r[k]], pa.binary())) for k in (0, 1)]
        kept = [entries.column(c) for c in ("tree", "index", "id", "other", "digest")]
        return pa.table([*kept, *sides, pa.array([subroot] * len(own), pa.binary())], schema=_PROVEN)

    return run


def proofs(rounds: list[DataFrame], above: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Every leaf with its proof: per level, the digests of its run ``before`` and ``after`` its own, joined.

    ``above`` (tree, before, after, subroot) has the proofs of the trees' own
    roots, where they go on; without a row for a tree they end at its root.
    """
    found = above.select("tree", F.lit(0).cast("long").alias("block"), "before", "after", "subroot")
    for r in range(len(rounds) - 1, -1, -1):
        pairs = rounds[r].groupBy("tree", "block").cogroup(found.groupBy("tree", "block"))
        found = pairs.applyInArrow(_prove(r, levels), PROVEN)
        if r:
            found = found.select("tree", F.col("index").alias("block"), "before", "after", "subroot")
    return found


def fold(digest: Column, before: Column, after: Column) -> Column:
    """The root (hex) that a leaf's digest (binary) and its proof lead to."""

    def up(now: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.lower(F.hex(step["before"])), now, F.lower(F.hex(step["after"]))), 256)

    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), F.lower(F.hex(digest)), up)


def proof_text(before: Column, after: Column) -> Column:
    """All digests of a proof as hex, level by level, left to right."""
    joined = F.transform(
        F.arrays_zip(before.alias("before"), after.alias("after")),
        lambda step: F.lower(F.hex(F.concat(step["before"], step["after"]))),
    )
    return F.array_join(joined, "")


def manifest(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs of all leaves up to the root over all trees.

    ``leaves`` has (tree, id, other, digest), see ``tree_key`` and
    ``leaf_digest``; ``other`` (binary) is carried along. Returns (tree, index,
    id, other, digest, before, after, subroot, root), digests as binary;
    ``index`` is the leaf's place in its tree.
    """
    spark = bound_batches(leaves).sparkSession
    rounds = append_logs(ranked(leaves, shuffle_partitions(spark)), levels)
    # the trees' roots, in the order of their keys (kept in ``other``), are the leaves of one tree more
    over = with_row_index(tree_roots(rounds).select(F.encode("tree", "utf-8").alias("other"), "digest"), ["other"])
    top = append_logs(over.select(F.lit("").alias("tree"), "index", F.lit(None).cast("long").alias("id"), "other", "digest"), levels)
    found = tree_roots(top).first()
    none = spark.createDataFrame([], "tree string, before array<binary>, after array<binary>, subroot binary")
    above = proofs(top, none, levels).select(
        F.decode("other", "utf-8").alias("tree"), "before", "after", F.col("digest").alias("subroot")
    )
    root = F.lit(bytes(found["digest"]) if found else None).cast("binary")
    return proofs(rounds, checkpointed(above), levels).withColumn("root", root)


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """Every document's leaf, proof and roots; half of them, by the checksum of the id, are verified after a
    change that takes the newlines out of their text.

    A null id has no checksum, and its row isn't changed.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    own = [F.col(c) for c in fields]
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    changed = changed & F.contains("text", F.lit("\n"))
    leaves = docs.select(
        tree_key(F.col("source")).alias("tree"),
        F.col("doc_id").cast("long").alias("id"),
        F.when(changed, leaf_digest(*own, F.replace("text", F.lit("\n"), F.lit("")))).alias("other"),
        leaf_digest(*own, F.col("text")).alias("digest"),
    )
    found = manifest(leaves)
    hexed = lambda c: F.lower(F.hex(c))
    folded = found.withColumn("folded", fold(F.coalesce("other", "digest"), F.col("before"), F.col("after")))
    return folded.select(
        F.col("id").alias("doc_id"),
        hexed("digest").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        F.sha2(proof_text(F.col("before"), F.col("after")), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == hexed("root")).alias("verified"),
    )


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: CRC-32 of a decimal id, bit by bit.
_CRC_SQL = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),"
    " lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),"
    " lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"
)

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
         {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown
  FROM documents
), nodes AS (
  SELECT source, 0 AS l, i, leaf AS h FROM leaves
  UNION ALL
  SELECT source, l + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM nodes) WHERE c > 1 GROUP BY source, l, i // {ARITY}
), subroots AS (
  SELECT source, max(l) AS top, arg_max(h, l) AS h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
  FROM nodes GROUP BY source
), upper AS (
  SELECT 0 AS l, i, h FROM subroots
  UNION ALL
  SELECT l + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY l, i // {ARITY}
), steps AS (
  SELECT d.doc_id, d.i AS leaf_i, d.source, n.l AS step, n.i AS i, d.i // ({ARITY} ** n.l)::BIGINT AS own, n.h
  FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  JOIN nodes n ON n.source IS NOT DISTINCT FROM d.source AND n.l < s.top
   AND n.i // {ARITY} = d.i // ({ARITY} ** (n.l + 1))::BIGINT
  UNION ALL
  SELECT d.doc_id, d.i, d.source, s.top + u.l, u.i, s.i // ({ARITY} ** u.l)::BIGINT, u.h
  FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
  JOIN upper u ON u.l < (SELECT max(l) FROM upper) AND u.i // {ARITY} = s.i // ({ARITY} ** (u.l + 1))::BIGINT
), runs AS (
  SELECT source, leaf_i, step, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS before,
         coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS after
  FROM steps GROUP BY source, leaf_i, step
), folded AS (
  SELECT source, i, 0 AS step, shown AS h FROM leaves
  UNION ALL
  SELECT f.source, f.i, f.step + 1, sha256(r.before || f.h || r.after)
  FROM folded f JOIN runs r ON r.source IS NOT DISTINCT FROM f.source AND r.leaf_i = f.i AND r.step = f.step
), ends AS (
  SELECT source, i, arg_max(h, step) AS folded_root FROM folded GROUP BY source, i
), proofs AS (
  SELECT source, leaf_i, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256 FROM runs GROUP BY source, leaf_i
)
SELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
       e.folded_root, e.folded_root = r.h AS verified
FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source
JOIN ends e ON e.source IS NOT DISTINCT FROM d.source AND e.i = d.i
LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM d.source AND p.leaf_i = d.i
CROSS JOIN (SELECT arg_max(h, l) AS h FROM upper) r
"""
