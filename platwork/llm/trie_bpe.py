"""BPE encoding by prefix-sharing trie traversal, and decoding.

Method. The last token of a text's encoding determines the rest: it is the one token that ends the text,
encodes to itself, and stands unmerged behind the last token of what is left without it. So a state of
one token per prefix is enough. The distinct words of a block of documents are put into a trie, in order,
so that the current word is the path from the root and the next one begins where the two part; a
depth-first walk gives every node its last token once, from its ancestors on the path, and a word's
encoding is read off backwards. Prefixes that words share are encoded once. Words met before are looked
up, up to a bound in bytes. Documents are read once and nothing is shuffled; a lost task runs again.

Whether two tokens stay apart follows from the merges alone: along the right edge of the first and the
left edge of the second token's merge tree, no merge across may come before the next one inside.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platwork.llm.common import slices, table

TOKENIZER = "byte_bpe_50k.json"
# Text bytes per block; bytes of remembered words and number of remembered pairs per Python worker.
BLOCK_BYTES = 6 << 20
KNOWN_BYTES = 96 << 20
KNOWN_PAIRS = 400_000
# What a remembered word takes besides its text and ids; longer words are not remembered.
WORD_COST, LONG_WORD = 200, 1024
# Depths of the walk whose open tokens are kept; below them they are found again.
KEPT_DEPTH = 256
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others from 256 on in their order."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Merges:
    """Tokens numbered in the order of their merges, bytes first, and which of them stay apart."""

    def __init__(self, tokenizer: dict) -> None:
        model, before = tokenizer["model"], tokenizer.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or tokenizer.get("normalizer") or odd or model.get("ignore_merges"):
            raise ValueError("Only byte-level BPE without normalizer, prefix space, dropout or marks is supported")
        letters = byte_letters()
        number, ids = {c: b for b, c in enumerate(letters)}, [model["vocab"][c] for c in letters]
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.text = [bytes([b]) for b in range(256)]
        self.made: dict[int, int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a not in number or b not in number or a + b in number:
                raise ValueError(f"A merge of unmade parts, or of a token made before: {merge}")
            new = number[a + b] = len(self.text)
            self.parts.append((number[a], number[b]))
            self.text.append(self.text[number[a]] + self.text[number[b]])
            self.made[number[a] << 32 | number[b]] = new
            ids.append(model["vocab"][a + b])
        self.ids, self.length = ids, [*map(len, self.text)]
        self.longest = max(self.length)
        back = dict(zip(letters, range(256)))
        self.bytes_of = dict(zip(ids, self.text))
        self.added = {t["content"]: t["id"] for t in tokenizer.get("added_tokens") or []}
        for t in tokenizer.get("added_tokens") or []:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError(f"Added tokens with conditions are not supported: {t['content']}")
            spelled = [back.get(c) for c in t["content"]]
            self.bytes_of[t["id"]] = t["content"].encode() if None in spelled else bytes(spelled)
        self.apart: dict[int, bool] = {}
        self.kept_whole: list[bool | None] = [True] * 256 + [None] * (len(self.text) - 256)
        # States of the tokens' own trie: where a byte leads, and the token that ends there.
        self.step: dict[int, int] = {}
        self.ends = [-1]
        for token, text in enumerate(self.text):
            at = 0
            for byte in text:
                after = self.step.get(at << 8 | byte)
                if after is None:
                    after = self.step[at << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                at = after
            self.ends[at] = token

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens at the left (0) or right (1) edge of a token's merge tree, from the byte up."""
        out = [token]
        while (parts := self.parts[out[-1]]) is not None:
            out.append(parts[side])
        return out[::-1]

    def _first_across(self, a: int, b: int) -> tuple[int, int] | None:
        """The two tokens that the merges join first across the border of ``a`` and ``b``, if any."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        never = len(self.text)
        while True:
            inner, outer = left[i + 1] if i + 1 < len(left) else never, right[j + 1] if j + 1 < len(right) else never
            across = self.made.get(left[i] << 32 | right[j], never)
            # Of equal merges the one further left comes first.
            if across < inner and across <= outer and across < never:
                return left[i], right[j]
            if inner == outer == never:
                return None
            if inner <= outer:
                i += 1
            else:
                j += 1

    def stay_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > KNOWN_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._first_across(a, b) is None
        return known

    def whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as the token."""
        known = self.kept_whole[token]
        if known is None:
            parts = self.parts[token]
            known = self.kept_whole[token] = self.whole(parts[0]) and self.whole(parts[1]) and self._first_across(*parts) == parts
        return known

    def _open(self, states: list[int], byte: int) -> list[int]:
        """The token-trie states of the tokens that may end later, longest first."""
        step = self.step
        return [s for s in (step.get(at << 8 | byte) for at in (*states, 0)) if s is not None]

    def encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each distinct word, as little-endian unsigned 32-bit integers."""
        step, ends, length, ids, apart, kept_whole = self.step, self.ends, self.length, self.ids, self.apart, self.kept_whole
        begins = [step[byte] for byte in range(256)]
        order, flat, edges = sorted(words), [], [0]
        path, last, opened = b"", [], [[]]
        for word in order:
            # The trie's branch up to where this word leaves the one before.
            depth = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                depth += 1
            del last[depth:]
            if depth < len(opened):
                del opened[depth + 1 :]
                states = opened[depth]
            else:
                states = []
                for byte in word[max(0, depth - self.longest) : depth]:
                    states = self._open(states, byte)
            for d in range(depth, len(word)):
                byte = word[d]
                states = [s for at in states if (s := step.get(at << 8 | byte)) is not None]
                states.append(begins[byte])
                if d + 1 < KEPT_DEPTH:
                    opened.append(states)
                for s in states:
                    token = ends[s]
                    if token < 0:
                        continue
                    whole = kept_whole[token]
                    if whole or whole is None and self.whole(token):
                        start = d + 1 - length[token]
                        if start:
                            before = last[start - 1]
                            fits = apart.get(before << 32 | token)
                            if fits is None:
                                fits = self.stay_apart(before, token)
                            if not fits:
                                continue
                        last.append(token)
                        break
            path, at, spelled = word, len(word), []
            while at:
                token = last[at - 1]
                spelled.append(ids[token])
                at -= length[token]
            spelled.reverse()
            flat += spelled
            edges.append(4 * len(flat))
        packed = np.array(flat, "<u4").tobytes()
        return {word: packed[a:b] for word, a, b in zip(order, edges, edges[1:])}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Worker:
    """What one Python worker keeps between blocks: the merges and the words met so far."""

    held: dict[str, _Worker] = {}

    def __init__(self, tokenizer: bytes, pattern: str) -> None:
        self.merges, self.pattern = Merges(json.loads(tokenizer)), regex.compile(pattern)
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in self.merges.added.items()}
        marks = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, bytes] = {}
        self.size = 0

    @classmethod
    def of(cls, tokenizer: bytes, pattern: str) -> _Worker:
        key = hashlib.sha256(tokenizer + pattern.encode()).hexdigest()
        if key not in cls.held:
            cls.held[key] = cls(tokenizer, pattern)
        return cls.held[key]

    def _words(self, text: str) -> list[str]:
        if self.marks is None or not any(m in text for m in self.added):
            return self.pattern.findall(text)
        parts = self.marks.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.pattern.findall(p))]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(t) for t in texts]
        fresh = {w: w.encode() for w in set().union(*cut) if w not in self.known and w not in self.added}
        spelled = self.merges.encode([*set(fresh.values())])
        new = {w: spelled[b] for w, b in fresh.items()}
        found = {**self.added, **{w: i for w, i in new.items() if len(i) + len(w) > LONG_WORD}}
        kept = {w: i for w, i in new.items() if w not in found}
        self.known.update(kept)
        self.size += sum(len(w) + len(i) + WORD_COST for w, i in kept.items())
        if found:
            known = self.known
            out = [b"".join([found[w] if w in found else known[w] for w in words]) for words in cut]
        else:
            out = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        return out


def encode_documents(docs: DataFrame, tokenizer: bytes, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document its ``n_tokens``, ``ids`` and the ``decoded`` text.

    ``tokenizer`` is the tokenizer file, ``pattern`` cuts texts into words. Added tokens in a text are
    that token; bytes that are no UTF-8 decode to U+FFFD. Whole texts; null and empty ones give no
    ids and an empty text. Every row gives one row, repeated or not, and other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker.of(*shared.value)
        for part in (s for batch in batches for s in slices(batch, "text", BLOCK_BYTES)):
            ids = worker.encode([t or "" for t in part.column("text").to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            sizes = np.array([len(i) // 4 for i in ids], np.int64)
            edges = np.r_[0, np.cumsum(sizes)]
            decoded = [worker.merges.decode(flat[a:b].tolist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(flat)), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def read_tokenizer(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def op11_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), read_tokenizer(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
