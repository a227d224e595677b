"""Exact n-gram Jaccard join by set-relation skipping, and its connected groups.

Method. A document's set holds the hashes of its distinct word shingles; equal sets form one class
from the start. All shingles are counted exactly over the classes, as arrays dealt by hash: a
shingle of one class only can be shared with no other, so just the shared ones travel on, and a
class with too few of them is done. Classes are indexed under the first shingles of their set, the
rarest first, as many as the threshold asks for (prefix filter).

An index list is cut into blocks by set size; a probe opens only the blocks whose sizes can reach
the threshold, and passes over postings with too few shared tokens from there on (index skipping).
The answers of a class are derived from those of classes similar to it (answer skipping): each block
first compares its members with one of them, links found join classes into groups, and from then on
only classes of different groups are compared. The members of a list's smaller groups first visit one
block of the list's largest group, as long as that joins many of them to it; those left over visit all
other groups of the list. What is skipped is linked already, so the groups are the exact ones.
"""

from __future__ import annotations

import xxhash
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import LOWER_ASCII, give_back, raw_bytes, slices, stored, table
from platwork.operators.skew import salted_join

KNOWN_WORDS = 150_000
FLUSH_TOKENS = 750_000
FLUSH_DOCS = 30_000
BUCKET_BYTES = 12 << 20  # of text
LEAST_BUCKETS = 8
MASK = np.uint64((1 << 48) - 1)
STAR_ROUNDS = 2
# Sets per block of a visited group, and visitors per piece.
BLOCK_SETS, PIECE_VISITORS = 256, 4096
# Short visits go on while they join at least this share of the visitors.
JOINED_SHARE = 1 / 8


class Shingles(dict):
    """Word -> hash, and the sets made of them."""

    def __init__(self, width: int) -> None:
        super().__init__()
        self.width = width

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Sorted hashes of the distinct shingles; fewer words than the width make one."""
        words = text.translate(LOWER_ASCII).split()
        if not words:
            return np.empty(0, np.uint64)
        codes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = max(1, len(codes) - self.width + 1)
        out = np.full(n, min(len(codes), self.width), np.uint64)
        for i in range(min(len(codes), self.width)):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[i : i + n]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out = out ^ (out >> np.uint64(31))
        out.sort()
        return out[np.r_[True, out[1:] != out[:-1]]]


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), len(shingles)))))


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, class, n_shingles) per row; no class for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shingles(width)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [known.of(t) for t in raw_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(map(len, sets), pa.int64())],
                    ["doc_id", "class", "n_shingles"],
                )
        del known
        give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, class long, n_shingles long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _cut(edges: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    return zip(edges.tolist(), [*edges[1:].tolist(), size])


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in columns sorted together."""
    n = len(sorted_columns[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _packed(tokens: np.ndarray) -> bytes:
    return (tokens & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (tokens >> np.uint64(32)).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    n = memoryview(data).nbytes // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def shared_sets(docs: DataFrame, width: int, percent: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(class, n, prefix array of (token, left), shared): the classes that can have a partner.

    ``shared`` holds the set's tokens (48 bits) that other classes have too, sorted. ``prefix`` are
    the indexed ones, the rarest first, with the number of shared tokens from that one on.
    """
    rows = _texts(docs)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, ceil(size / bucket_bytes))

    def send(held: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(s) for s in held])
        tokens, owner = np.concatenate(held), np.repeat(np.arange(len(held)), lengths)
        spot = ((tokens >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
        order = np.argsort(spot * len(held) + owner, kind="stable")
        classes = np.array(names, np.int64)
        for a, b in _cut(_starts(spot[order]), len(order)):
            own = order[a:b]
            # Only the sets with a token in this bucket.
            first = _starts(owner[own])
            which = owner[own[first]]
            counts = np.diff(np.r_[first, b - a]).astype("<u4")
            held_here = classes[which].tobytes(), lengths[which].astype("<u4").tobytes(), counts.tobytes(), _packed(tokens[own] & MASK)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(spot[own[0]])], pa.int32()), *(pa.array([x], pa.binary()) for x in held_here)], ["bucket", "classes", "sizes", "counts", "tokens"]
            )

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, held, names, total = Shingles(width), set(), [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for text in raw_bytes(part.column("text")):
                    shingles = known.of(text)
                    if not len(shingles) or (name := class_of(shingles)) in seen:
                        continue
                    seen.add(name)
                    held.append(shingles)
                    names.append(name)
                    total += len(shingles)
                    if total >= FLUSH_TOKENS or len(held) >= FLUSH_DOCS:
                        yield from send(held, names)
                        # Copies that lie further apart meet in the bucket, where pairs are made distinct.
                        held, names, total, seen = [], [], 0, set()
        if held:
            yield from send(held, names)
        del known, seen, held, names
        give_back()

    def count(group: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in group.column(name)])

        # Sets by number, so that a token carries 4 bytes of its set while they are sorted.
        names, code = np.unique(column("classes", np.int64), return_inverse=True)
        size_of = np.zeros(len(names), np.int64)
        size_of[code] = column("sizes", "<u4")
        owner = np.repeat(code.astype(np.int32), column("counts", "<u4"))
        tokens = np.concatenate([_unpacked(v.as_buffer()) for v in group.column("tokens")])
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        del order
        once = _starts(tokens, owner)
        tokens, owner = tokens[once], owner[once]
        spans = np.diff(np.r_[_starts(tokens), len(tokens)])
        df = np.repeat(spans, spans).astype(np.int32)
        keep = df >= 2
        tokens, owner, df = tokens[keep], owner[keep], df[keep]
        del once, spans, keep
        spot = (names.view(np.uint64) % np.uint64(buckets)).astype(np.int32)[owner]
        order = np.lexsort((owner, spot))
        tokens, owner, df, spot = tokens[order], owner[order], df[order], spot[order]
        classes, sizes = names[owner], size_of[owner]
        out = []
        for a, b in _cut(_starts(spot), len(spot)):
            first = _starts(classes[a:b])
            counts = np.diff(np.r_[first, b - a])
            out.append(
                (
                    int(spot[a]), classes[a:b][first].tobytes(), sizes[a:b][first].astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
                    _packed(tokens[a:b]), np.minimum(df[a:b], 65535).astype("<u2").tobytes(),
                )
            )
        kinds = [pa.int32(), *[pa.binary()] * 5]
        names = ["spot", "classes", "sizes", "counts", "tokens", "df"]
        del tokens, classes, sizes, df, spot, order, owner
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)], names=names)

    def assemble(group: pa.Table) -> pa.Table:
        parts = [[] for _ in range(4)]
        for r in group.to_pylist():
            own = np.frombuffer(r["counts"], "<u4")
            for k, x in enumerate((np.repeat(np.frombuffer(r["classes"], np.int64), own), np.repeat(np.frombuffer(r["sizes"], "<u4"), own), _unpacked(r["tokens"]), np.frombuffer(r["df"], "<u2"))):
                parts[k].append(x)
        classes, sizes, tokens, df = map(np.concatenate, parts)
        order = np.lexsort((tokens, df, classes))
        classes, sizes, tokens = classes[order], sizes[order].astype(np.int64), tokens[order]
        out = []
        for a, b in _cut(_starts(classes), len(classes)):
            n, own = int(sizes[a]), b - a
            least = -(-percent * n // 100)
            if own < least:
                continue
            # The n - own tokens of no other class come first in the order and are not indexed.
            indexed = tokens[a : a + own - least + 1].astype(np.int64).tolist()
            prefix = [{"token": t, "left": own - i} for i, t in enumerate(indexed)]
            out.append((int(classes[a]), n, prefix, _packed(np.sort(tokens[a:b]))))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("token", pa.int64()), ("left", pa.int64())])), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, kinds)], names=["class", "n", "prefix", "shared"])

    sent = rows.mapInArrow(scatter, "bucket int, classes binary, sizes binary, counts binary, tokens binary")
    counted = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, "spot int, classes binary, sizes binary, counts binary, tokens binary, df binary")
    return counted.groupBy("spot").applyInArrow(assemble, "class long, n long, prefix array<struct<token:long,left:long>>, shared binary")


def _needed(a: Column, b: Column, percent: int) -> Column:
    """The smallest intersection of sets of these sizes that links them."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100.0 + percent) - 1e-9)


def _can_link(x: str, y: str, percent: int) -> Column:
    """Two postings of one token leave room for a link if it is the first token they share.

    Every pair that links meets at its first common token, and there all tokens it shares lie from
    that one on: ``left`` counts them in each set, those of no other class left out.
    """
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.least(f"left{x}", f"left{y}") >= _needed(n, m, percent))


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the candidate ``pairs`` (x, y) those that link, as a spanning forest of each task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(v: int) -> int:
            while (u := above.get(v, v)) != v:
                above[v] = above.get(u, u)
                v = u
            return v

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = top(r["x"]), top(r["y"])
                if a == b:
                    continue
                p, q = _unpacked(r["sx"]), _unpacked(r["sy"])
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int(np.count_nonzero(q[at] == p))
                if 100 * common >= percent * (r["nx"] + r["ny"] - common):
                    above[max(a, b)] = min(a, b)
                    out.append((r["x"], r["y"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["x", "y"])

    first = pairs.join(sets.select(F.col("class").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("sx")), "x")
    both = first.join(sets.select(F.col("class").alias("y"), F.col("n").alias("ny"), F.col("shared").alias("sy")), "y")
    return both.select("x", "nx", "sx", "y", "ny", "sy").mapInArrow(run, "x long, y long")


def connected(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(class, comp): every class on an edge with the smallest class that it is connected to.

    Each round takes the smallest label among the neighbours and then that label's own label, so
    the number of rounds grows with the logarithm of the longest path. After ``rounds`` rounds, if
    given, labels may still differ within a group, but never agree across groups.

    Both joins read stored tables: a small one is broadcast by its size, and in larger ones the
    adaptive join splits classes with very many neighbours or members.
    """
    ways = stored(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels = stored(ways.groupBy(F.col("x").alias("class")).agg(F.least("x", F.min("y")).alias("comp")), "labels")
    done = 0
    while True:
        sent = ways.join(labels.select(F.col("class").alias("x"), "comp"), "x").select(F.col("y").alias("class"), "comp", F.lit(None).cast("long").alias("old"))
        own = labels.select("class", "comp", F.col("comp").alias("old"))
        stepped = stored(own.unionByName(sent).groupBy("class").agg(F.min("comp").alias("via"), F.max("old").alias("old")), "stepped")
        jumped = stepped.join(stepped.select(F.col("class").alias("via"), F.col("via").alias("comp")), "via")
        after = stored(jumped.select("class", "old", "comp"), "labels")
        labels, done = after.select("class", "comp"), done + 1
        if done == rounds or after.filter("old <> comp").isEmpty():
            return labels


def linked_classes(sets: DataFrame, percent: int) -> DataFrame:
    """(class, comp) of all classes that link with another, directly or by others."""
    # Blocks of sizes: two sets that link lie in one block or in neighbouring ones.
    band = F.floor(F.log("n") / F.lit(log(100 / percent))) if percent < 100 else F.col("n")
    postings = stored(
        sets.select("class", "n", F.explode("prefix").alias("p")).select("class", "n", band.cast("int").alias("band"), "p.token", "p.left"), "postings"
    )
    labelled, edges, comps = postings.withColumn("comp", F.col("class")), None, None
    for number in range(STAR_ROUNDS):
        pairs = _star_pairs(labelled, number, percent)
        # Each pair once, whichever way round it was met.
        pairs = stored(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
        links = stored(verified_links(pairs, sets, percent), "links")
        edges = links if edges is None else edges.unionByName(links)
        # Labels between the rounds only save comparisons.
        comps = connected(edges, 3)
        labelled = stored(postings.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "labelled")
    lists = stored(_mixed_lists(labelled), "merged-lists")
    while True:
        groups = _list_groups(lists, comps)
        short = stored(_visits(*groups, percent, largest_only=True), "short-visits")
        links = stored(_visited_links(short, sets, comps, percent, one_block=True), "links")
        joined, asked = links.select("x").distinct().count(), short.select("x").distinct().count()
        if joined:
            edges = edges.unionByName(links)
            comps = connected(edges, 3)
        if joined <= asked * JOINED_SHARE:
            break
    visits = stored(_visits(*(_list_groups(lists, comps) if joined else groups), percent), "visits")
    rest = stored(_visited_links(visits, sets, comps, percent), "links")
    # A visitor may link with any member of a group, so the labels' own links count as well.
    return connected(edges.unionByName(rest))


def _star_pairs(labelled: DataFrame, number: int, percent: int) -> DataFrame:
    """Each posting of a block with the block's pivot and with that of the block of sizes just below."""
    choice = F.xxhash64("token", "class", F.lit(number))
    pivots = labelled.groupBy("token", "band").agg(F.min(F.struct(choice.alias("h"), "class", "n", "left", "comp")).alias("p"))
    pivots = stored(pivots.select("token", "band", *(F.col(f"p.{c}").alias(f"{c}y") for c in ("class", "n", "left", "comp"))), "pivots")
    served = pivots.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    members = labelled.withColumnsRenamed({"class": "classx", "n": "nx", "left": "leftx", "comp": "compx"})
    met = members.join(served, ["token", "band"])
    return met.filter((F.col("compx") != F.col("compy")) & _can_link("x", "y", percent)).select(F.col("classx").alias("x"), F.col("classy").alias("y"))


def _mixed_lists(labelled: DataFrame) -> DataFrame:
    """(list, class, n, left): the lists that hold several groups.

    Shingles of one shared passage have lists of the same classes. Such lists are one here, with the
    most tokens that any of them leaves a class, so a passage is met once and not at every shingle.
    """
    seal = lambda salt: F.bit_xor(F.xxhash64("class", F.lit(salt)))
    lists = labelled.groupBy("token").agg(F.count("*").alias("times"), seal(0).alias("s0"), seal(1).alias("s1"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    several = lists.filter("lo <> hi").select("token", F.struct("times", "s0", "s1").alias("list"))
    return labelled.join(several, "token").groupBy("list", "class", "n").agg(F.max("left").alias("left"))


def _list_groups(lists: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of lists outside the list's largest group, and the groups of each list."""
    merged = stored(lists.join(comps, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "list-members")
    per = stored(
        merged.groupBy("list", "comp").agg(
            F.count("*").alias("times"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("left").alias("lefty")
        ),
        "list-groups",
    )
    mixed = stored(per.groupBy("list").agg(F.max_by("comp", F.struct("times", "comp")).alias("main")), "lists")
    probes = stored(merged.join(mixed, "list").filter("comp <> main").select("list", "class", "n", "left", F.col("comp").alias("own")), "probes")
    return probes, per.join(mixed, "list")


def _visits(probes: DataFrame, groups: DataFrame, percent: int, largest_only: bool = False) -> DataFrame:
    """(x, comp): the members of :func:`_list_groups`, and the other groups of their lists, or only
    the largest ones, whose members they could link with."""
    met = probes.join(groups.filter("comp = main") if largest_only else groups, "list")
    smallest = F.greatest("least_n", F.ceil(F.col("n") * percent / 100.0 - 1e-9))
    near = (F.col("most_n") >= smallest) & (F.col("least_n") * percent <= F.col("n") * 100)
    room = F.least("left", "lefty") >= _needed(F.col("n"), smallest, percent)
    once = (F.col("comp") == F.col("main")) | (F.col("own") < F.col("comp"))
    return met.filter((F.col("own") != F.col("comp")) & once & near & room).select(F.col("class").alias("x"), "comp").distinct()


def _visited_links(visits: DataFrame, sets: DataFrame, comps: DataFrame, percent: int, one_block: bool = False) -> DataFrame:
    """One link for each visiting class and block of the visited group, where there is one; of all
    blocks, or of one only.

    Groups are cut into blocks of members and their visitors into pieces, so that a task holds one
    block and meets its visitors one after the other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, ready = None, [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = r["comp"], r["block"], r["piece"]
                if key != at:
                    at, members, ready = key, [], None
                own = _unpacked(r["shared"])
                if not r["visits"]:
                    members.append((r["class"], r["n"], own))
                    continue
                if ready is None:
                    tokens, owner = np.concatenate([m[2] for m in members]), np.repeat(np.arange(len(members)), [len(m[2]) for m in members])
                    order = np.argsort(tokens, kind="stable")
                    ready = tokens[order], owner[order], np.array([m[1] for m in members])
                tokens, owner, sizes = ready
                first, last = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
                spans = last - first
                spots = np.repeat(first - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
                common = np.bincount(owner[spots], minlength=len(members))
                linked = np.flatnonzero(100 * common >= percent * (sizes + r["n"] - common))
                if len(linked):
                    out.append((r["class"], members[linked[0]][0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["x", "y"])

    named = sets.join(comps, "class", "left").select("class", "n", "shared", F.coalesce("comp", "class").alias("comp"))
    visitors = visits.groupBy("comp").agg(F.count("*").alias("visitors"))
    sizes = stored(named.join(visitors, "comp").groupBy("comp").agg(
        F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"), F.ceil(F.first("visitors") / PIECE_VISITORS).cast("int").alias("pieces")
    ), "group-sizes")
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = named.join(sizes, "comp").withColumn("block", spread("class", "blocks")).withColumn("piece", each("pieces")).withColumn("visits", F.lit(False))
    guests = visits.join(sizes, "comp").withColumnRenamed("x", "class").withColumn("piece", spread("class", "pieces")).withColumn("block", spread("class", "blocks") if one_block else each("blocks"))
    guests = guests.join(sets.select("class", "n", "shared"), "class").withColumn("visits", F.lit(True))
    columns = ["comp", "block", "piece", "visits", "class", "n", "shared"]
    stream = held.select(columns).unionByName(guests.select(columns)).repartition("comp", "block", "piece")
    return stream.sortWithinPartitions("comp", "block", "piece", "visits").mapInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 85, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): ``n_shingles``, ``class_id`` and ``component_id``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets. ``component_id`` is
    the smallest id reachable by links. Null, empty and blank texts have an empty set and link with
    nothing, not even each other. Shingles are told apart by 64-bit hashes, in comparisons by 48.
    Repeated rows are rows of their own; a null id is never the smallest of others.
    """
    held = stored(document_sets(docs, width), "sets")
    sets = stored(shared_sets(docs, width, percent, bucket_bytes), "shared")
    comps = linked_classes(sets, percent)
    classes = stored(held.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "classes")
    linked = classes.join(comps, "class", "left")
    groups = linked.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("group_least"))
    named = linked.join(stored(groups, "groups"), "comp", "left").filter("times > 1 OR group_least IS NOT NULL")
    named = stored(named.select("class", F.coalesce("group_least", "least").alias("component"), "times"), "named")
    out = salted_join(held, named.select("class", "component"), ["class"], named.select("class", "times"), "times", "left")
    return out.select("doc_id", "n_shingles", F.col("class").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
