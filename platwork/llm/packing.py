"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Method: the pieces of the documents are dealt into parts of a bounded number of pieces; each part is
packed by best-fit decreasing. Dual feasible functions give a lower bound of the part's number of
sequences. A part that meets its bound is certified and gives back only its emptiest sequence; a
part with a gap gives back every sequence that is not full. What is given back is dealt anew over
all such parts and packed again, and the better of both packings stays.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from math import ceil

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from platwork.llm.common import raw_bytes, slices, stored, table

TOKENIZER = "word_bpe_49k.json"
LENGTH = 2048
PART_PIECES = 4096
LEAST_PARTS = 16
ROUNDS = 4
# Remembered per Python worker: chunks within a task, words beyond it.
KNOWN_CHUNKS, KNOWN_WORDS = 400_000, 250_000
END = b"\0\0\0\0"


class WordTokens(dict):
    """Ids of a text by a tokenizer that drops white space, chunk by chunk between ASCII blanks.

    Printable Latin chunks are cut by the tokenizer's own pattern and their words looked up; every
    other chunk goes through the whole tokenizer. Special tokens' strings are ordinary text.
    """

    held: dict[str, WordTokens] = {}

    def __init__(self, source: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True
        made = json.loads(source)
        steps = [n["type"] for n in made["normalizer"]["normalizers"]], [p["type"] for p in made["pre_tokenizer"]["pretokenizers"]]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"Not a tokenizer that drops white space: {steps}")
        self.cut = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # Byte-level letters: printable bytes stand for themselves, the others for U+0100 onwards.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + i for i, b in enumerate(rest)}
        self.words: dict[str, bytes] = {}

    @classmethod
    def of(cls, source: str) -> WordTokens:
        key = hashlib.sha256(source.encode()).hexdigest()
        if key not in cls.held:
            cls.held[key] = cls(source)
        return cls.held[key]

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > KNOWN_WORDS:
                self.words.clear()
            mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.words[word] = np.array([t.id for t in self.tokenizer.model.tokenize(mapped)], "<u4").tobytes()
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > KNOWN_CHUNKS:
            self.clear()
        text = chunk.decode()
        if text.isprintable() and (text.isascii() or max(text) < "ɐ" and unicodedata.is_normalized("NFC", text)):
            ids = b"".join(map(self._word, self.cut(text.lower())))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self[chunk] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def tokenized_pieces(docs: DataFrame, source: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of at most ``length`` tokens.

    A document is its ids followed by id 0, so a null or empty text is one piece of one token. Only
    longer ones are cut. Repeated rows are documents of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                owner, piece, start, size, check, kept = [], [], [], [], [], []
                for i, text in enumerate(raw_bytes(part.column("text"))):
                    ids = tokens.ids(text) + END
                    for k, at in enumerate(range(0, len(ids), 4 * length)):
                        own = ids[at : at + 4 * length]
                        owner.append(i), piece.append(k), start.append(at // 4), size.append(len(own) // 4), check.append(zlib.crc32(own))
                        if with_ids:
                            kept.append(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                        *(pa.array(c, pa.int64()) for c in (start, size, check)), *([pa.array(kept, pa.binary())] if with_ids else []),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
                )
        tokens.clear()

    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of ``sizes`` has fewer bins: the best of three families of dual feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1)
    best = ceil(int(count @ size) / capacity)
    # Threshold functions: above capacity - t a whole bin, below t nothing, between them the size.
    many, load = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    above = many[-1] - many[capacity - t]
    between = load[capacity - t] - load[t - 1]
    best = max(best, int(np.max(above - (-between // capacity))))
    # Rounding functions: floor((k + 1) x) / k, and x itself where (k + 1) x is whole.
    for k in range(1, 24):
        whole = size * (k + 1) % capacity == 0
        value = np.where(whole, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, ceil(int(count @ value) / (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each size, and the space left in each bin. Equal sizes go in the order given."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    left: list[int] = []
    having: dict[int, list[int]] = {}
    spaces: list[int] = []  # the different amounts of space left, ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(spaces, size)
        if at < len(spaces):
            space = spaces[at]
            b = having[space].pop()
            if not having[space]:
                del having[space], spaces[at]
        else:
            b, space = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        left[b] = space - size
        if left[b]:
            if left[b] not in having:
                having[left[b]] = []
                insort(spaces, left[b])
            having[left[b]].append(b)
    return bins, offsets, left


def _packer(capacity: int, round_number: int):
    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("item", "ascending")])
        sizes = group.column("length").to_numpy()
        bins, offsets, left = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        space = np.array(left)
        # Certified: only the emptiest sequence could still be merged with one of another part.
        back = space > 0 if len(left) > bound else np.arange(len(left)) == int(np.argmax(space))
        back &= space > 0
        part = group.column("part")[0].as_py()
        made = {
            "sequence_id": (round_number << 56) + (part << 24) + bins, "offset": offsets, "given_back": back[bins],
            "part_sequences": np.full(len(sizes), len(left)), "part_bound": np.full(len(sizes), bound),
        }
        for name, values in made.items():
            group = group.set_column(group.schema.get_field_index(name), name, pa.array(values))
        return group

    return pack


def pack_pieces(
    pieces: DataFrame, capacity: int = LENGTH, part_pieces: int = PART_PIECES, rounds: int = ROUNDS, least_parts: int = LEAST_PARTS
) -> DataFrame:
    """``pieces`` (``length`` from 1 to ``capacity``) with ``sequence_id`` and a gapless ``offset`` from 0.

    Further columns stay; ``item``, ``part``, ``given_back``, ``part_sequences`` and ``part_bound``
    are taken. An empty table gives an empty one. Equal pieces are packed each on its own.
    """
    extra = {"sequence_id": "long", "offset": "long", "given_back": "boolean", "part_sequences": "long", "part_bound": "long"}
    held = stored(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    for name, kind in extra.items():
        held = held.withColumn(name, F.lit(None).cast(kind))
    columns = held.columns
    full = held.filter(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("item") - 1, "offset": F.lit(0).cast("long")})
    out, pool, before = [full], held.filter(F.col("length") < capacity), None
    for number in range(1, rounds + 1):
        n = pool.count()
        if not n:
            break
        parts = max(ceil(n / part_pieces), min(least_parts, ceil(n / 256)))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(parts)).cast("long"))
        schema = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
        packed = stored(dealt.groupBy("part").applyInArrow(_packer(capacity, number), schema), f"packed-{number}")
        counts = packed.agg(
            F.count_distinct("sequence_id").alias("all"), F.count_distinct(F.when(F.col("given_back"), F.col("sequence_id"))).alias("back")
        ).first()
        if before is not None and counts["all"] >= before[1]:
            pool = before[0]
            break
        out.append(packed.filter("NOT given_back").select(columns))
        pool = packed.filter("given_back").select(columns)
        before = (pool, counts["back"])
    out.append(pool)
    whole = out[0]
    for other in out[1:]:
        whole = whole.unionByName(other)
    return whole.drop("item", "given_back", "part_sequences", "part_bound")


def pack_documents(docs: DataFrame, source: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places; ``with_ids`` adds the token ids themselves."""
    return pack_pieces(tokenized_pieces(docs, source, length, with_ids), length)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the contents of each sequence, from pieces packed with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    start = F.lit(b"").cast("binary")
    return joined.select("sequence_id", F.aggregate("parts", start, lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def tokenizer_source(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack_documents(docs, tokenizer_source(public_tokenizers.path(TOKENIZER)))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
