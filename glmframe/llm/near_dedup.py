"""MinHash near-dedup (operator 9): banded candidates, checked by odd sketches, confirmed on full sets.

1. Every document becomes the set of its word shingles, MinHash samples of the
   set, band keys of the samples, and an odd sketch: each sample toggles one
   bit of a bitmap, so the XOR of two bitmaps counts the samples in which the
   sets differ.
2. Documents with equal sets are collapsed to the smallest id of them.
3. Only documents that share a band key are compared. First each with one hub,
   the smallest id under any of its keys: a row per document, however large a
   group is. That settles most groups of copies.
4. Keys whose documents still lie in several components are compared again:
   the members of the largest component on one side, all others on both, in
   units of at most two chunks of bounded size, keys with the same documents
   once. Pairs within a component are left out.
5. In either step a unit first holds odd sketches alone, 128 bytes a document.
   Full shingle sets are fetched only for documents with a pair whose sketches
   may reach the threshold, and only links that join two components of a unit
   are emitted, so a unit of n documents yields at most n - 1 rows.
6. The components of the confirmed links are the result.

Losses: with the production bands a pair at exactly the threshold misses all
common band keys with a probability under 1e-8 (``miss_probability``); the
odd-sketch bound is five standard deviations of the sample count wide.

Defined cases: a null, empty or white-space text has the empty set and is
linked with nothing; fewer words than a shingle make one shingle; rows with
one id are one node, tied to each other; a row without an id is linked with
nothing, has a null component and is kept. Other columns pass untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glmframe.llm.common import (
    bound_batches,
    checkpointed,
    connected_components,
    join_repeated,
    mix64,
    shuffle_partitions,
    slices,
    span_hashes,
    utf8,
    words_of,
)

BANDS = 48
BAND_ROWS = 5
SKETCH_BITS = 1024
#: A chunk of a unit: about so many documents, and about so many shingles.
CHUNK_DOCS = 256
CHUNK_SHINGLES = 1 << 20
#: Bits of the map that tells which texts a join needs (4 MB, whatever the input).
WANTED_BITS = 1 << 25
SIGNATURE = "id long, n_shingles long, high long, low long, bands array<long>, sketch binary"


def miss_probability(similarity: float, bands: int = BANDS, rows: int = BAND_ROWS) -> float:
    """Probability that a pair of this similarity shares no band key."""
    return (1 - similarity**rows) ** bands


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text: the sorted distinct hashes of its ``width``-word shingles, A-Z in lower case."""
    for a, b in slices(texts):
        _, _, hashes, first = words_of(texts[a:b], lower=True)
        n_words = np.diff(first)
        n_starts = np.where(n_words < width, np.minimum(n_words, 1), n_words - width + 1)
        cuts = np.concatenate([[0], np.cumsum(n_starts)])
        starts = np.arange(cuts[-1]) + np.repeat(first[:-1] - cuts[:-1], n_starts)
        ends = np.minimum(starts + width, np.repeat(first[1:], n_starts))
        # one prefix sum for the words of all texts of the slice
        shingles = span_hashes(hashes, starts, ends)
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(shingles[begin:end])


def _permutations(samples: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(20240917))
    a = random.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
    return a, random.integers(0, 1 << 32, samples, dtype=np.uint32)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of a * x + b modulo 2**32 over the set, for each sample."""
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        part = x[at : at + 2048]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Bitmap (as uint64 words) in which each (sample number, value) toggles one bit."""
    key = mix64((np.arange(len(samples), dtype=np.uint64) << np.uint64(32)) | samples.astype(np.uint64))
    odd = np.bincount((key % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def odd_estimate(differing: float, samples: int, bits: int = SKETCH_BITS) -> float:
    """Similarity that an XOR population count of ``differing`` speaks for."""
    return 1 + bits / (4 * samples) * math.log(max(1 - 2 * differing / bits, 1e-9))


def odd_limit(percent: int, samples: int, bits: int = SKETCH_BITS) -> int:
    """Largest XOR population count that a pair at the threshold may show.

    Each sample that differs, a binomial variable, toggles a bit in both
    sketches; what these leave odd is expected for five standard deviations
    more than the mean, and some bits are allowed for how they fall.
    """
    p = 1 - percent / 100
    differing = samples * p + 5 * math.sqrt(samples * p * (1 - p))
    return math.ceil(bits / 2 * (1 - math.exp(-4 * differing / bits)) + 8)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _permutations(BANDS * BAND_ROWS)
        for batch in batches:
            rows: list[tuple] = []
            for shingles in shingle_sets(utf8(batch.column("text")), width):
                if not len(shingles):
                    rows.append((0, 0, 0, [], b""))
                    continue
                samples = minhash(shingles, a, b)
                grid = samples.astype(np.uint64).reshape(BANDS, BAND_ROWS)
                # the band's number and values, as a polynomial hash
                coded = np.column_stack([np.arange(1, BANDS + 1, dtype=np.uint64), grid]).ravel()
                at = np.arange(BANDS) * (BAND_ROWS + 1)
                keys = span_hashes(coded, at, at + BAND_ROWS + 1).view(np.int64)
                both = np.array([shingles.sum(), (shingles * shingles ^ (shingles >> np.uint64(7))).sum()]).view(np.int64)
                rows.append((len(shingles), int(both[0]), int(both[1]), keys, odd_sketch(samples).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns], names=["id", "n_shingles", "high", "low", "bands", "sketch"]
            )

    return run


def _member_sets(width: int):
    """Replaces the text of a member by its full shingle set; rows that follow an equal one go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            texts, take = utf8(batch.column("text")), []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in MEMBER_NAMES), texts, strict=True)):
                if row != last:
                    take.append(i)
                last = row
            known: dict[bytes, bytes] = {}  # a member of many units has one set
            for i in take:
                known.setdefault(texts[i], b"")
            for text, shingles in zip(known, shingle_sets(list(known), width), strict=True):
                known[text] = shingles.tobytes()
            rest = batch.take(pa.array(take, pa.int64()))
            at = batch.schema.get_field_index("text")
            yield rest.set_column(at, "shingles", pa.array([known[texts[i]] for i in take], pa.binary()))

    return run


def near_pairs(parts: np.ndarray, groups: np.ndarray, sketches: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later members) whose sketches may reach the threshold, of different groups (and parts, if there are two)."""
    across = len(np.unique(parts)) > 1
    for i in range(len(parts) - 1):
        other = groups[i + 1 :] != groups[i]
        if across:
            other &= parts[i + 1 :] != parts[i]
        near = i + 1 + np.flatnonzero(other)
        if len(near):
            near = near[np.bitwise_count(sketches[i] ^ sketches[near]).sum(axis=1) <= limit]
        if len(near):
            yield i, near


def links_within(
    ids: list[int],
    parts: np.ndarray,
    groups: np.ndarray,
    sketches: np.ndarray,
    sets: list[np.ndarray],
    limit: int,
    percent: int,
) -> list[tuple]:
    """Spanning links (id, id) of the components that pairs at or over the threshold make.

    Members of one group are linked already. With members of two parts only
    pairs across are compared.
    """
    links = []
    label = np.unique(groups, return_inverse=True)[1]  # the component of each member, kept flat
    size = np.array([len(s) for s in sets])
    for i, near in near_pairs(parts, groups, sketches, limit):
        near = near[label[near] != label[i]]
        # sets that differ too much in size can't reach the threshold
        near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
        if not len(near):
            continue
        own, cuts = sets[i], np.cumsum([0, *size[near]])
        other = np.concatenate([sets[j] for j in near])
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        common = np.add.reduceat((own[at] == other).astype(np.int64), cuts[:-1])
        for j in near[100 * common >= percent * (size[i] + size[near] - common)].tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                links.append((ids[i], ids[j]))
    return links


#: A unit's rows follow one another: unit, part of the row in it, document, the component it is in so far, sketch.
MEMBER = "family long, one long, two long, part long, id long, comp long, sketch binary"
MEMBER_NAMES = [x.split()[0] for x in MEMBER.split(", ")]


def _by_unit(work):
    """Calls ``work`` with the columns of each unit, and yields the rows that it returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            found: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key and rows:
                    found += work(rows)
                    rows = []
                key = row[:3]
                rows.append(row)
            yield from batched(found)
        if rows:
            yield from batched(work(rows))

    def batched(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            names = MEMBER_NAMES if len(found[0]) > 2 else ["u", "v"]
            kinds = [pa.binary() if n == "sketch" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    return run


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sketches = np.frombuffer(b"".join(r[6] for r in rows), dtype=np.uint64).reshape(len(rows), -1)
    return np.array([r[3] for r in rows]), np.array([r[5] for r in rows]), sketches


def _gate(limit: int):
    """The members of a unit that have a pair whose sketches may reach the threshold."""

    def work(rows: list[tuple]) -> list[tuple]:
        some: set[int] = set()
        for i, near in near_pairs(*_arrays(rows), limit):
            some.add(i)
            some.update(near.tolist())
        return [rows[i] for i in sorted(some)]

    return _by_unit(work)


def _confirm(limit: int, percent: int):
    """Links of each unit, on full sets (the last column)."""

    def work(rows: list[tuple]) -> list[tuple]:
        sets = [np.frombuffer(r[7], dtype=np.uint64) for r in rows]
        return links_within([r[4] for r in rows], *_arrays(rows), sets, limit, percent)

    return _by_unit(work)


def _wanted(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts that the members may need, so that a join with these moves few others.

    Hashes of the members' ids are marked in a bitmap of a fixed size, which
    is broadcast; a text passes if its bit is set. Other ids may share a bit,
    so the join itself still decides; a full map lets all texts pass.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(WANTED_BITS))
    marked = members.select(slot.alias("slot"))
    marked = marked.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    placed = texts.where("id is not null").withColumns({"bucket": F.bitmap_bucket_number(slot), "bit": F.bitmap_bit_position(slot)})
    byte = F.expr("cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)")
    return placed.join(F.broadcast(marked), "bucket").where(F.getbit(byte, F.expr("cast(bit % 8 as int)")) == 1).select("id", "text")


def _links(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (u, v) that the units' members confirm: sketches first, then the sets of those that may be linked."""
    parts, limit = shuffle_partitions(units.sparkSession), odd_limit(percent, BANDS * BAND_ROWS)
    unit, order = ["family", "one", "two"], ["family", "one", "two", "part", "id"]
    gated = units.select(*MEMBER_NAMES).repartition(parts, *unit).sortWithinPartitions(*order)
    left = checkpointed(gated.mapInArrow(_gate(limit), MEMBER))
    sets = _wanted(texts, left).join(left, "id").select(*MEMBER_NAMES, "text")
    sets = sets.mapInArrow(_member_sets(width), f"{MEMBER}, shingles binary")
    full = sets.repartition(parts, *unit).sortWithinPartitions(*order)
    return checkpointed(full.mapInArrow(_confirm(limit, percent), "u long, v long"))


def _chunks(docs: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(docs / CHUNK_DOCS), F.ceil(shingles / CHUNK_SHINGLES))


def _hub_units(shared: DataFrame, sketches: DataFrame) -> DataFrame:
    """Each document with one hub, the smallest id under any of its keys, ``CHUNK_DOCS`` documents a unit."""
    spokes = shared.where("id <> least").groupBy("id").agg(F.min("least").alias("family"), F.max("n_shingles").alias("m"))
    spokes = checkpointed(spokes)
    hubs = spokes.groupBy("family").agg(F.count("*").alias("n"), _chunks(F.count("*"), F.sum("m")).alias("chunks"))
    # the hub stands in each of its units
    sides = hubs.select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("one"), F.lit(0).alias("part"), F.col("family").alias("id"))
    rows = join_repeated(spokes, hubs, ["family"], spokes.count())
    rows = rows.select("family", F.pmod(F.xxhash64("family", "id"), F.col("chunks")).alias("one"), F.lit(1).alias("part"), "id")
    members = rows.unionByName(sides).withColumn("two", F.col("one"))
    return members.join(sketches, "id").withColumn("comp", F.col("id"))


def _key_units(shared: DataFrame, sketches: DataFrame, components: DataFrame) -> DataFrame:
    """Documents under keys that still join several components, the largest one's on one side only."""
    comp = F.coalesce("component", "id").alias("comp")
    placed = checkpointed(shared.join(components, F.col("id") == F.col("node"), "left").select("key", "id", "n_shingles", comp))
    mixed = placed.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("print"),
    )
    # keys with the same documents once
    mixed = mixed.where("low < high").groupBy("n", "print").agg(F.min("key").alias("key"))
    sizes = placed.join(mixed.select("key"), "key", "left_semi").groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    whole = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "m")).alias("most"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    rest = _chunks(F.col("n") - F.col("most.n"), F.col("m") - F.col("most.m"))
    base = _chunks(F.col("most.n"), F.col("most.m"))
    whole = checkpointed(whole.select("key", "n", F.col("most.comp").alias("base"), base.alias("b"), rest.alias("t")))
    rows = join_repeated(placed, whole, ["key"], placed.count())
    in_base, first = F.col("comp") == F.col("base"), F.lit(0).cast("long")
    chunk = F.when(in_base, F.pmod(F.xxhash64("id"), F.col("b"))).otherwise(F.col("b") + F.pmod(F.xxhash64("id"), F.col("t")))
    others = F.sequence(F.when(in_base, F.col("b")).otherwise(first), F.col("b") + F.col("t") - 1)
    rows = rows.join(sketches, "id").withColumns({"part": chunk, "other": F.explode(others)})
    return rows.withColumns({"family": F.col("key"), "one": F.least("part", "other"), "two": F.greatest("part", "other")})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union.

    Returns one row per row of ``docs``: ``id``, ``n_shingles`` (size of the
    set) and ``component_id`` (the smallest id reachable over links, the own
    included; null without an id).
    """
    spark = bound_batches(docs).sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = checkpointed(texts.mapInArrow(_signatures(width), SIGNATURE))

    # equal sets are tied to the smallest id without any comparison
    same = ["n_shingles", "high", "low"]
    sets = signed.where("n_shingles > 0 and id is not null")
    least = checkpointed(sets.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    total = least.agg(F.sum("n")).first()[0] or 0
    tied = checkpointed(join_repeated(sets.select("id", *same), least, same, total).select("id", "rep", *same))
    reps = tied.where("id = rep").select("id", *same).distinct()
    own = checkpointed(sets.join(reps, ["id", *same], "left_semi").select("id", "n_shingles", "bands", "sketch").distinct())
    sketches = own.select("id", "sketch")

    # documents by band key, where two have it
    banded = own.select("id", "n_shingles", F.explode("bands").alias("key"))
    keys = banded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
    keys = checkpointed(keys.where("least < most").select("key", "least", "n"))
    shared = checkpointed(join_repeated(banded, keys, ["key"], BANDS * own.count()).select("key", "id", "n_shingles", "least").distinct())

    hubs = _links(_hub_units(shared, sketches), texts, width, percent)
    rest = _links(_key_units(shared, sketches, connected_components(hubs)), texts, width, percent)
    links = hubs.union(rest)

    # rows of one id with different sets: the id ties the representatives of these
    several = tied.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    bridges = tied.join(several.select("id"), "id").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    components = connected_components(links.union(bridges))
    alone = signed.where("n_shingles = 0 or id is null").select("id", F.col("id").alias("rep"), "n_shingles")
    found = tied.select("id", "rep", "n_shingles").union(alone).join(components, F.col("rep") == F.col("node"), "left")
    return found.select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op9_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: three-word shingles, 85 of 100."""
    found = near_duplicates(docs, width=3, percent=85)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
