"""Packing of token sequences: best fit, longest first, within groups.

Every document becomes ids of a byte-level BPE and one end id. An overlong one is first cut into full windows of
CAPACITY ids; what is left over is placed whole: pieces in decreasing length, each into the open window with the least
room that still takes it. A segment tree over the possible rooms finds that window. Pieces are dealt evenly to groups
of about GROUP pieces, each packed by one task on its own, so no task grows with the input; a group wastes part of its
last windows only.

Ids come from a word cache: where no two white-space characters meet, a line's words are encoded one by one with the
space before them, which gives the ids of the whole text (white space never joins such a word); other texts, and those
that hold an added token's text, are encoded whole. The end id is END.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are packed each; very long
texts give many windows; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import staged

CAPACITY, GROUP, END, CACHE = 2048, 8192, 1, 100_000
#: Fixed value: the pattern that splits text before merges, as published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TWO_SPACES = re.compile(r"\s\s|^\s|\s$")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """text -> bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {a["content"] for a in spec.get("added_tokens", [])}
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.added = path, added
        self.inner, self.first = _Words(self.fast, " "), _Words(self.fast, "")
        self.newline = self.encode_plain("\n")

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, for the few texts that hold an added token's text."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode_plain(self, text: str) -> bytes:
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if _TWO_SPACES.search(text):
            return self.encode_plain(text)
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(self.first[head] + b"".join(map(self.inner.__getitem__, rest)))
        out = self.newline.join(lines)
        for words in (self.inner, self.first):
            if len(words) > CACHE:
                words.clear()
        return out


class _Words(dict):
    def __init__(self, fast, before: str):
        super().__init__()
        self.fast, self.before = fast, before

    def __missing__(self, word: str) -> bytes:
        ids = array.array("I", self.fast.encode_ordinary(self.before + word)).tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of full windows and what is left."""
    n, view = len(ids) // 4, memoryview(ids)
    return [(a, min(capacity, n - a), zlib.crc32(view[4 * a : 4 * min(a + capacity, n)])) for a in range(0, n, capacity)]


class Rooms:
    """Open windows by room left: a segment tree whose leaves are the rooms 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.open = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        i = room + self.size
        while i and not self.open[i]:
            self.open[i] = True
            i //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """A window with the smallest room that is at least so large, and its room; it is removed."""
        i = least + self.size
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.at[room].pop()
        if not self.at[room]:
            while i:
                self.open[i] = i < self.size and (self.open[2 * i] or self.open[2 * i + 1])
                if self.open[i]:
                    break
                i //= 2
        return window, room


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(window, offset) of each piece; lengths must not increase. Windows are numbered from 0 as they are opened."""
    rooms, out, n = Rooms(capacity), [], 0
    for size in lengths:
        got = rooms.take(size)
        if got is None:
            got, n = (n, capacity), n + 1
        window, room = got
        out.append((window, capacity - room))
        if room > size:
            rooms.put(room - size, window)
    return out


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and a salt that differs by piece."""
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, n = encoder(vocabulary), TaskContext.get().partitionId() << 36
        end = array.array("I", [END]).tobytes()
        for b in batches:
            rows = []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = enc.encode(text) + end
                rows += [(k, *p, len(ids) // 4) for p in cut(ids)]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), *cols[1:], pa.array(range(n, n + len(rows)), pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])
            n += len(rows)

    return d.mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, salt long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    got = staged(pieces(docs, vocabulary or default_vocabulary()), "pieces")
    groups = max(1, -(-got.count() // group))

    def pack(t):
        import pyarrow as pa

        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("salt", "ascending")])
        placed = best_fit(t["length"].to_pylist())
        g = t["g"][0].as_py()
        t = t.drop_columns(["salt", "g"])
        return t.append_column("sequence_id", pa.array([g + groups * w for w, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    kind = got.schema["doc_id"].dataType.simpleString()
    return got.withColumn("g", F.pmod(F.xxhash64("salt"), F.lit(groups))).groupBy("g").applyInArrow(pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
