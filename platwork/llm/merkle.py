"""Merkle manifest of a document table: leaf places by bitmap ranks, levels by keyed slot arrays.

Method. Every row becomes a leaf. The ids of a group (a language) are held as bitmaps of 4,096 ids,
each with a directory of the ids before every word of 64; the parts that tasks make are merged per
bitmap. Running sums over the bitmaps, in three levels of at most 2^18 rows each, give the ids before
each bitmap, so a leaf's place in its group is a rank query: no leaf is sorted. Leaves are then dealt
by place into blocks of 4,096, and each task puts a block's digests at their slots and hashes four
levels of the tree. The blocks' nodes are the leaves of the next round, until one node is left per
group; the groups' nodes make the uppermost tree in the same way. On the way down every block gets
the siblings above it, as one row, and gives each of its leaves its proof.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platwork.llm.common import LOWER_ASCII, slices, stored, table

# Children of a node, and levels that one task hashes at once.
FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
# Ids per bitmap; fewer than ARRAY of them are listed instead.
LOW_BITS = 12
IDS, ARRAY = 1 << LOW_BITS, 256
# Bits of a bitmap's number that each level of running sums adds up.
UP_BITS = 17
TOP = "top"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = (
    "grp string, position long, doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)
# Copies of a row that one array of places holds.
STRETCH = 1 << 16
KEYS = ["grp", "space", "high"]


def sha_hex(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def leaf_digest(values: list[bytes | None]) -> bytes:
    """Of each value its number of bytes, a colon and the bytes, or a dash for null."""
    return hashlib.sha256(b"".join(b"-" if v is None else b"%d:%s" % (len(v), v) for v in values)).digest()


def lower_third(doc_id: bytes | None, text: bytes | None) -> bytes | None:
    """The tampering of the query: lower-case A-Z where 3 divides the id's crc32."""
    if doc_id is None or text is None or zlib.crc32(doc_id) % 3:
        return text
    return text.translate(LOWER_ASCII)


def leaves(docs: DataFrame, alter: Callable[[bytes | None, bytes | None], bytes | None] | None = None) -> DataFrame:
    """(grp, doc_id, space, place, leaf, altered, copies): equal rows once, with their number.

    ``grp`` is the language behind a 1, or 0 for null. ``place`` orders the leaves of a ``space``:
    the id, or, in the space before it, the digest's first 8 bytes where the id is null.
    ``altered`` is the leaf of the altered text where that differs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for batch in batches for s in slices(batch, "text")):
            columns = [c.cast(pa.binary()).to_pylist() for c in part.columns[1:]]
            ids, out = part.column(0).to_pylist(), []
            for number, *values in zip(ids, *columns):
                leaf = leaf_digest(values)
                text = alter(values[0], values[4]) if alter else values[4]
                other = None if text == values[4] else leaf_digest([*values[:4], text])
                place = int.from_bytes(leaf[:8]) - (1 << 63) if number is None else number
                lang = values[2]
                out.append((b"0" if lang is None else b"1" + lang, number, int(number is not None), place, leaf, other))
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([made[0].cast(pa.string()), *made[1:]], ["grp", "doc_id", "space", "place", "leaf", "altered"])

    rows = docs.select(docs["doc_id"].cast("long").alias("number"), *(docs[c].cast("string").alias(c) for c in FIELDS))
    made = rows.mapInArrow(run, "grp string, doc_id long, space int, place long, leaf binary, altered binary")
    return made.groupBy("grp", "doc_id", "space", "place", "leaf", "altered").agg(F.count("*").alias("copies"))


def _high() -> Column:
    return F.shiftright("place", LOW_BITS)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """The stretches of rows of one bitmap, as (key, start, end)."""
    grp, space, high = batch.column("grp").to_pylist(), batch.column("space").to_numpy(), batch.column("high").to_numpy()
    codes = batch.column("grp").dictionary_encode().indices.to_numpy()
    edges = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (space[1:] != space[:-1]) | (high[1:] != high[:-1])])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(codes)]):
        yield (grp[a], int(space[a]), int(high[a])), a, b


def _packed(weights: np.ndarray) -> tuple[bytes, bytes]:
    """The ids of a positive weight, as a list or a bitmap, and the (id, weight) of those above one."""
    lows = np.flatnonzero(weights)
    many = lows[weights[lows] > 1]
    bits = lows.astype("<u2").tobytes() if len(lows) < ARRAY else np.packbits(weights > 0, bitorder="little").tobytes()
    return bits, np.stack([many, weights[many]]).astype("<i8").tobytes()


def _add(weights: np.ndarray, bits: bytes, many: bytes) -> None:
    if len(bits) < IDS // 8:
        weights[np.frombuffer(bits, "<u2")] += 1
    else:
        weights += np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    lows, times = np.frombuffer(many, "<i8").reshape(2, -1)
    weights[lows] += times - 1


def id_bitmaps(held: DataFrame) -> DataFrame:
    """(grp, space, high, bits, many, total): the merged bitmap of each stretch of ids."""
    schema = "grp string, space int, high long, bits binary, many binary, total long"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        names = [*KEYS, "bits", "many", "total"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # Rows of one bitmap side by side; their ids stay as they come.
            codes = batch.column("grp").dictionary_encode().indices.to_numpy()
            order = np.lexsort((batch.column("high").to_numpy(), batch.column("space").to_numpy(), codes))
            batch = batch.take(pa.array(order))
            lows = batch.column("place").to_numpy() & (IDS - 1)
            copies = batch.column("copies").to_numpy()
            for key, a, b in _runs(batch):
                weights = np.zeros(IDS, np.int64)
                np.add.at(weights, lows[a:b], copies[a:b])
                out.append((*key, *_packed(weights), int(copies[a:b].sum())))
            yield batch_of(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = None, None
        for batch in batches:
            out, bits, many = [], batch.column("bits").to_pylist(), batch.column("many").to_pylist()
            for key, a, b in _runs(batch):
                if key != at:
                    if at:
                        out.append((*at, *_packed(weights), int(weights.sum())))
                    at, weights = key, np.zeros(IDS, np.int64)
                for i in range(a, b):
                    _add(weights, bits[i], many[i])
            yield batch_of(out)
        if at:
            yield batch_of([(*at, *_packed(weights), int(weights.sum()))])

    parts = held.select("grp", "space", "place", "copies", _high().alias("high")).mapInArrow(part, schema)
    return parts.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(merge, schema)


def _before(within: list[str], order: list[str]) -> Column:
    span = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("total").over(span), F.lit(0))


def directory(bitmaps: DataFrame) -> DataFrame:
    """The bitmaps with ``offset``, the leaves of the group before them, and ``size``, those of the group.

    Three levels of running sums, so that no window holds more than 2^18 rows, however ids lie.
    """
    low = bitmaps.select(*KEYS, "total", F.shiftright("high", UP_BITS).alias("up")).withColumn("b0", _before(["grp", "space", "up"], ["high"]))
    mid = bitmaps.groupBy("grp", "space", F.shiftright("high", UP_BITS).alias("up")).agg(F.sum("total").alias("total"))
    mid = stored(mid.withColumn("over", F.shiftright("up", UP_BITS)).withColumn("b1", _before(["grp", "space", "over"], ["up"])), "directory")
    top = mid.groupBy("grp", "space", "over").agg(F.sum("total").alias("total")).withColumn("b2", _before(["grp"], ["space", "over"]))
    sizes = mid.groupBy("grp").agg(F.sum("total").alias("size"))
    found = low.drop("total").join(mid.drop("total"), ["grp", "space", "up"]).join(top.drop("total"), ["grp", "space", "over"]).join(sizes, "grp")
    offsets = found.select(*KEYS, (F.col("b0") + F.col("b1") + F.col("b2")).alias("offset"), "size")
    return bitmaps.join(offsets, KEYS)


class _Bitmap:
    """One bitmap with its directory, and rank queries."""

    def __init__(self, bits: bytes, many: bytes, offset: int, size: int) -> None:
        self.offset, self.size = offset, size
        dense = bits
        if len(bits) < IDS // 8:
            mask = np.zeros(IDS, bool)
            mask[np.frombuffer(bits, "<u2")] = True
            dense = np.packbits(mask, bitorder="little").tobytes()
        self.words = np.frombuffer(dense, "<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.many, times = np.frombuffer(many, "<i8").reshape(2, -1)
        self.extra = np.r_[0, np.cumsum(times - 1)]

    def rank(self, lows: np.ndarray) -> np.ndarray:
        """The leaves of the group before each id."""
        word = lows >> 6
        inside = self.words[word] & ((np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1))
        below = self.before[word] + np.bitwise_count(inside)
        return self.offset + below + self.extra[np.searchsorted(self.many, lows)]


def positions(held: DataFrame, index: DataFrame) -> DataFrame:
    """(grp, position, size, doc_id, leaf, altered) of every leaf; equal rows lie side by side."""
    schema = "grp string, position long, size long, doc_id long, leaf binary, altered binary, copies long"
    names = [f.split()[0] for f in schema.split(", ")]

    def batch_of(own: pa.RecordBatch, grp: str, place: np.ndarray, size: int) -> pa.RecordBatch:
        n = own.num_rows
        columns = [pa.array([grp] * n, pa.string()), pa.array(place, pa.int64()), pa.array(np.full(n, size), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *(own.column(c) for c in names[3:])], names)

    def ties(rows: list[pa.RecordBatch], at: tuple, bitmap: _Bitmap) -> Iterator[pa.RecordBatch]:
        """Rows of one id: by leaf, then by altered leaf."""
        if rows:
            own = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            own = own.take(pa.compute.sort_indices(own, [("place", "ascending"), ("leaf", "ascending"), ("altered", "ascending")]))
            lows, copies = own.column("place").to_numpy() & (IDS - 1), own.column("copies").to_numpy()
            run = np.cumsum(copies) - copies
            first = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1]])
            start = np.repeat(run[first], np.diff(np.r_[first, len(lows)]))
            yield batch_of(own, at[0], bitmap.rank(lows) + run - start, bitmap.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bitmap, waiting = None, None, []
        for batch in batches:
            for key, a, b in _runs(batch):
                if key != at:
                    yield from ties(waiting, at, bitmap)
                    head = batch.slice(a, 1).to_pylist()[0]
                    at, waiting, a = key, [], a + 1
                    bitmap = _Bitmap(head["bits"], head["many"], head["offset"], head["size"])
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                lows = own.column("place").to_numpy() & (IDS - 1)
                repeated = np.isin(lows, bitmap.many)
                if repeated.any():
                    # A single row that stands for copies needs no order among others, but is rare.
                    waiting.append(own.filter(pa.array(repeated)))
                    own, lows = own.filter(pa.array(~repeated)), lows[~repeated]
                if own.num_rows:
                    yield batch_of(own, key[0], bitmap.rank(lows), bitmap.size)
        yield from ties(waiting, at, bitmap)

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = index.select(
        *KEYS, F.lit(0).alias("kind"), "bits", "many", "offset", "size",
        *(none(k, c) for c, k in (("place", "long"), ("doc_id", "long"), ("leaf", "binary"), ("altered", "binary"), ("copies", "long"))),
    )
    rows = held.select(
        "grp", "space", _high().alias("high"), F.lit(1).alias("kind"), none("binary", "bits"), none("binary", "many"), none("long", "offset"),
        none("long", "size"), "place", "doc_id", "leaf", "altered", "copies",
    )
    dealt = heads.unionByName(rows).repartition(*KEYS).sortWithinPartitions(*KEYS, "kind")
    ranked = dealt.mapInArrow(run, schema)
    end = F.col("position") + F.col("copies") - 1
    parts = ranked.withColumn("end", end).withColumn("first", F.explode(F.sequence("position", "end", F.lit(STRETCH).cast("long"))))
    each = F.explode(F.sequence("first", F.least("end", F.col("first") + STRETCH - 1)))
    return parts.select("grp", each.alias("position"), "size", "doc_id", "leaf", "altered")


def depth_of(size: int) -> int:
    """Levels above the leaves until one node is left."""
    depth = 0
    while size > 1:
        size, depth = -(-size // FAN), depth + 1
    return depth


def _tree(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The levels above ``nodes`` (hex digests), themselves first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha_hex(b"".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
    return out


def _hex(digests: bytes) -> list[bytes]:
    text = digests.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(grp, block, size, ids, missing, leaves, altered, node) of nodes (grp, position, size, doc_id,
    leaf, altered): slot arrays of 4,096 digests and the node over them."""
    schema = "grp string, block long, size long, ids binary, missing binary, leaves binary, altered binary, node binary"

    def run(group: pa.Table) -> pa.Table:
        n, size = group.num_rows, group.column("size")[0].as_py()
        slots = group.column("position").to_numpy() % BLOCK
        ids, missing = np.zeros(n, np.int64), np.zeros(n, bool)
        ids[slots] = group.column("doc_id").fill_null(0).to_numpy()
        missing[slots] = group.column("doc_id").is_null().to_numpy()
        digests, altered = [b""] * n, [b""] * n
        for slot, leaf, other in zip(slots.tolist(), group.column("leaf").to_pylist(), group.column("altered").to_pylist()):
            digests[slot], altered[slot] = leaf, other or leaf
        held = b"".join(digests)
        node = bytes.fromhex(_tree(_hex(held), min(LEVELS, depth_of(size)))[-1][0].decode())
        row = (group.column("grp")[0].as_py(), group.column("block")[0].as_py(), size, ids.tobytes(), np.packbits(missing).tobytes(), held, b"".join(altered), node)
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[f.split()[0] for f in schema.split(", ")])

    dealt = nodes.withColumn("block", F.floor(F.col("position") / BLOCK).cast("long"))
    return dealt.groupBy("grp", "block").applyInArrow(run, schema)


def reduced(nodes: DataFrame, label: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round from the nodes up, and (grp, node) of the one node left per group."""
    rounds, done = [], None
    while True:
        blocks = stored(blocks_of(nodes), label)
        rounds.append(blocks)
        ended = blocks.filter(F.col("size") <= BLOCK).select("grp", "node")
        done = ended if done is None else done.unionByName(ended)
        open_ = blocks.filter(F.col("size") > BLOCK)
        if open_.isEmpty():
            return rounds, done
        nodes = open_.select(
            "grp", F.col("block").alias("position"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.lit(None).cast("long").alias("doc_id"),
            F.col("node").alias("leaf"), F.lit(None).cast("binary").alias("altered"),
        )


def _steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """What stands before and behind the node on each level of a stored path, as hex."""
    out, at = [], 0
    while at < len(path):
        slot, others = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 32 * others].hex().encode()
        out.append((text[: 64 * slot], text[64 * slot :]))
        at += 2 + 32 * others
    return out


def _inner(tree: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """What stands before and behind node ``i`` of the lowest level, and those above it."""
    out = []
    for level in tree[:-1]:
        start = i - i % FAN
        out.append((b"".join(level[start:i]), b"".join(level[i + 1 : start + FAN])))
        i //= FAN
    return out


def _as_path(steps: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join(bytes([len(a) // 64, (len(a) + len(b)) // 64]) + bytes.fromhex((a + b).decode()) for a, b in steps)


def paths_below(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, block, path) of the blocks one round lower: the siblings from their node to the root.

    ``above`` has the paths of ``blocks``; a path is, per level, the node's slot, its number of
    siblings, and their digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            tree = _tree(_hex(r["leaves"]), min(LEVELS, depth_of(r["size"])))
            n = len(tree[0])
            path = [_as_path(_inner(tree, i)) + r["path"] for i in range(n)]
            numbers = [r["block"] * BLOCK + i for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([r["grp"]] * n), pa.array(numbers, pa.int64()), pa.array(path, pa.binary())], ["grp", "block", "path"])

    met = blocks.select("grp", "block", "size", "leaves").join(above, ["grp", "block"])
    return met.mapInArrow(run, "grp string, block long, path binary")


def descended(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(grp, block, path) of the lowest round's blocks; ``roots`` has the paths of the groups' last nodes."""
    paths = None
    for number in reversed(range(len(rounds))):
        # Groups that need fewer rounds than others begin here.
        ended = rounds[number].filter(F.col("size") <= BLOCK).select("grp", "block").join(roots, "grp")
        paths = ended if paths is None else ended.unionByName(stored(paths_below(rounds[number + 1], paths), "paths"))
    return paths


def _numbered(groups: DataFrame) -> DataFrame:
    """(grp, position) of the groups in bytewise order, numbered by range partitions."""
    dealt = groups.repartitionByRange("grp").sortWithinPartitions("grp").withColumn("part", F.spark_partition_id())
    held = stored(dealt, "groups")
    sizes = held.groupBy("part").agg(F.count("*").alias("total"))
    starts = sizes.withColumn("one", F.lit(1)).withColumn("start", _before(["one"], ["part"])).select("part", "start")
    number = F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1
    return held.withColumn("number", number).join(starts, "part").select("grp", (F.col("start") + F.col("number")).alias("position"), "node")


def _proofs(blocks: DataFrame, paths: DataFrame, root: bytes) -> DataFrame:
    """The manifest's rows of the lowest blocks; ``paths`` has (grp, block, path, subroot)."""
    names = ["grp", "position", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    top = root.hex().encode()

    def rows_of(r: dict) -> list[tuple]:
        tree = _tree(_hex(r["leaves"]), min(LEVELS, depth_of(r["size"])))
        above, subroot = _steps(r["path"]), r["subroot"].hex()
        upper = b"".join(a + b for a, b in above)
        ids, missing = np.frombuffer(r["ids"], np.int64).tolist(), np.unpackbits(np.frombuffer(r["missing"], np.uint8)).tolist()
        out = []
        for i, (leaf, other) in enumerate(zip(tree[0], _hex(r["altered"]))):
            steps = _inner(tree, i)
            proof = b"".join(a + b for a, b in steps) + upper
            for a, b in (*steps, *above):
                other = sha_hex(a + other + b)
            out.append(
                (
                    r["grp"], r["block"] * BLOCK + i, None if missing[i] else ids[i], leaf.decode(), subroot, top.decode(),
                    hashlib.sha256(proof).hexdigest(), other.decode(), other == top,
                )
            )
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.bool_()]
        for r in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_of(r)), kinds)], names)

    met = blocks.drop("node").join(paths, ["grp", "block"])
    return met.mapInArrow(run, ROWS)


def manifest(docs: DataFrame, alter: Callable[[bytes | None, bytes | None], bytes | None] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): where it stands and its proof.

    ``grp``, ``position``, ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, the digest
    of its siblings from the leaf to the root, ``folded_root``, the root recomputed from the leaf
    of what ``alter(doc_id, text)`` makes of the text (both as bytes, null as None) and the siblings,
    and ``verified``, whether that is the root. Digests are lower-case hex.

    A null is a leaf's dash, so null and empty texts differ. Leaves without an id come first in their
    group, by digest; rows of one id stand by digest, and equal rows side by side, each with its own
    proof. Different rows of one id are held by one task, all else in blocks of 4,096. Other columns
    are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = stored(leaves(docs, alter), "leaves")
    index = directory(stored(id_bitmaps(held), "bitmaps"))
    rounds, ended = reduced(positions(held, index), "blocks")
    subroots = stored(_numbered(ended), "subroots")
    count = subroots.count()
    if not count:
        return spark.createDataFrame([], ROWS)
    upper = subroots.select(
        F.lit(TOP).alias("grp"), "position", F.lit(count).cast("long").alias("size"), F.lit(None).cast("long").alias("doc_id"),
        F.col("node").alias("leaf"), F.lit(None).cast("binary").alias("altered"),
    )
    over, last = reduced(upper, "upper")
    root = last.first()
    start = spark.createDataFrame([(TOP, b"")], "grp string, path binary")
    places = paths_below(over[0], descended(over, start)).select(F.col("block").alias("position"), "path")
    roots = stored(subroots.join(places, "position").select("grp", "path", F.col("node").alias("subroot")), "roots")
    paths = descended(rounds, roots.select("grp", "path")).join(roots.select("grp", "subroot"), "grp")
    return _proofs(rounds[0], paths, bytes(root["node"]))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"), lower_third)
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position")
