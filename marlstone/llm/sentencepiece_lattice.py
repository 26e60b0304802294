"""SentencePiece encoding as a relational lattice, and decoding.

Spaces become U+2581, one is put in front, and the text is cut into atoms wherever two neighbouring characters stand side
by side in no piece of the model (for this model, before every U+2581 that follows another character, around line ends
and tabs, and inside words). No piece spans a cut, so encoding the atoms apart is exact. An atom's substrings of up to the
longest piece's length are exploded and equi-joined to the piece table (a broadcast of the vocabulary's fixed size), the
edges are grouped by atom, and a higher-order aggregate folds them into a segmentation. For a BPE model that fold takes
the edges by rank and keeps the boundaries as bits of a long: an edge is merged if both its ends are boundaries and
exactly one lies between. A Viterbi fold of BPE scores would not give a BPE model's ids; `viterbi` is the fold for
unigram models. Atoms longer than MAX_WORD characters (more boundaries than a long has bits) take the same fold in
Python. Characters without a piece become their UTF-8 bytes.

The TOP most frequent atoms of a sample of about SAMPLE documents go through the lattice first and are broadcast: a table
of fixed size, which spares work and changes no result. The texts are read once, cut, and shuffled once by id and text
with the ids found so far and their other atoms; everything after, lattice included, stays in that partitioning.

Defined results: a null or empty text has no ids; decoding gives back the text (null gives an empty one); repeated
rows are encoded each; other columns are never read.
"""

from __future__ import annotations

import array
import functools
import heapq
import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
TOP, SAMPLE, MAX_WORD, HELD, NEAR, BLOCK = 400_000, 20_000, 62, 100_000, 0x250, 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, tuple[int, float]], list[int], list[str]]:
    """piece -> (id, score), the ids of the 256 bytes, and the pieces by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(len(sp))]
    pieces = {names[i]: (i, sp.get_score(i)) for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    return pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], names


@functools.cache
def joined_pairs(path: str) -> tuple[frozenset[str], np.ndarray]:
    """Every two characters that stand side by side in a piece, as text and as a table over the characters below NEAR,
    U+2581 and all others: 1 joined, 0 not, 2 to be looked up by text."""
    joined = frozenset(p[i : i + 2] for p in vocabulary(path)[0] for i in range(len(p) - 1))
    table = np.zeros((NEAR + 2, NEAR + 2), np.uint8)
    table[NEAR + 1, :] = table[:, NEAR + 1] = 2
    place = lambda c: NEAR if c == SPACE else min(ord(c), NEAR + 1)
    for pair in joined:
        x, y = map(place, pair)
        if NEAR + 1 not in (x, y):
            table[x, y] = 1
    return joined, table.ravel()


def atoms(text: str | None, path: str) -> list[str]:
    """The text with U+2581 for spaces and one in front, cut between characters that no piece joins."""
    if not text:
        return []
    joined, table = joined_pairs(path)
    t, cuts = SPACE + text.replace(" ", SPACE), [0]
    for a in range(0, len(t), BLOCK):
        c = np.frombuffer(t[a : a + BLOCK + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        near = np.minimum(c, NEAR + 1)
        near[c == ord(SPACE)] = NEAR
        state = table.take(near[:-1] * np.uint32(NEAR + 2) + near[1:])
        for k in np.flatnonzero(state == 2).tolist():
            state[k] = t[a + k : a + k + 2] in joined
        cuts += (np.flatnonzero(state == 0) + (a + 1)).tolist()
    return [t[i:j] for i, j in zip(cuts, [*cuts[1:], len(t)], strict=True)]


@functools.cache
def piece_ranks(path: str) -> tuple[dict[str, int], int]:
    """The place of every piece of two and more characters by falling score (equal scores share one), and the longest's length."""
    pieces = vocabulary(path)[0]
    place = {v: i for i, v in enumerate(sorted({-s for _, s in pieces.values()}))}
    return {p: place[-s] for p, (_, s) in pieces.items() if len(p) > 1}, max(map(len, pieces))


def encode_word(word: str, path: str) -> list[int]:
    """The BPE fold in Python, for words of any length: the best pair of neighbours first, the left one on ties. What is
    held is a number for every pair and two arrays of places, some 100 bytes a character."""
    pieces, byte, _ = vocabulary(path)
    rank, longest = piece_ranks(path)
    n = len(word)
    after, before = array.array("q", range(1, n + 2)), array.array("q", range(-1, n))
    heap = [r << 40 | i for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    dead = bytearray(n + 1)
    while heap:
        key = heapq.heappop(heap)
        r, i = key >> 40, key & (1 << 40) - 1
        if dead[i] or (j := after[i]) >= n:
            continue
        k = after[j]
        if k - i > longest or rank.get(word[i:k]) != r:
            continue
        dead[j], after[i] = 1, k
        if k < n:
            before[k] = i
            if after[k] - i <= longest and (r := rank.get(word[i : after[k]])) is not None:
                heapq.heappush(heap, r << 40 | i)
        if i and (h := before[i]) >= 0 and k - h <= longest and (r := rank.get(word[h:k])) is not None:
            heapq.heappush(heap, r << 40 | h)
    out, i = [], 0
    while i < n:
        p = word[i : after[i]]
        out += [pieces[p][0]] if p in pieces else [byte[b] for b in p.encode()]
        i = after[i]
    return out


@functools.cache
def piece_bytes(path: str) -> list[bytes]:
    _, byte, names = vocabulary(path)
    out = [p.encode() for p in names]
    for b, i in enumerate(byte):
        out[i] = bytes([b])
    return out


def decode(ids: list[int], path: str) -> str:
    raw = b"".join(map(piece_bytes(path).__getitem__, ids))
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    pieces, _, _ = vocabulary(path)
    return spark.createDataFrame([(p, i, float(s)) for p, (i, s) in pieces.items()], "piece string, id int, score double")


def edges(found: DataFrame, path: str) -> DataFrame:
    """found with s, e and score: a word's substrings of two and more characters that are pieces, and every word's first
    character whatever it is (no score), so that no row is lost; a null word has that edge only."""
    longest = max(map(len, vocabulary(path)[0]))
    size = F.coalesce(F.length("word"), F.lit(1))
    starts = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))))
    fits = F.when(size > MAX_WORD, 1).otherwise(longest)  # a longer word keeps its placeholder only
    room = F.least(fits, size - F.col("i") + 1)
    first = F.when(F.col("i") == 1, 1).otherwise(2)
    spans = starts.where((F.col("i") == 1) | (room >= 2)).withColumn("k", F.explode(F.sequence(first, room)))
    spans = spans.select(*found.columns, (F.col("i") - 1).alias("s"), (F.col("i") + F.col("k") - 1).alias("e"), F.expr("substring(word, i, k)").alias("piece"))
    rows = spans.join(F.broadcast(piece_table(found.sparkSession, path)), "piece", "left").where("id is not null or e = 1")
    return rows.select(*found.columns, "s", "e", "score")


def merges(ranked: Column, word: Column) -> Column:
    """The boundaries that a BPE model leaves, as bits; ranked: array of (rank, ends, inner) in order."""
    start = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(word) + 1) - 1
    ok = lambda m, e: (m.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(m.bitwiseAND(e["inner"])) == 1)
    return F.aggregate(ranked, start, lambda m, e: F.when(ok(m, e), m.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(m))


def viterbi(edges: Column, size: Column) -> Column:
    """The best-scoring path of a unigram lattice: an array of (s, e, id). Edges without a piece don't take part.

    The state is the best score and path to every place; edges come by their start, so every place is final when left.
    """
    none = F.array().cast("array<struct<s:int,e:int,id:int>>")
    first = F.transform(F.sequence(F.lit(0), size), lambda p: F.struct(F.when(p == 0, F.lit(0.0)).alias("v"), F.when(p == 0, none).alias("path")))
    order = F.array_sort(F.transform(F.filter(edges, lambda e: e["id"].isNotNull()), lambda e: F.struct(e["s"].alias("s"), e["e"].alias("e"), e["rank"].alias("rank"), e["id"].alias("id"))))

    def step(state: Column, e: Column) -> Column:
        a, b = F.get(state, e["s"]), F.get(state, e["e"])
        v = a["v"] - e["rank"]
        better = a["v"].isNotNull() & (b["v"].isNull() | (v > b["v"]))
        path = F.concat(a["path"], F.array(F.struct(e["s"].cast("int").alias("s"), e["e"].cast("int").alias("e"), e["id"].alias("id"))))
        return F.transform(state, lambda x, p: F.when((p == e["e"]) & better, F.struct(v.alias("v"), path.alias("path"))).otherwise(x))

    return F.get(F.aggregate(order, first, step), size)["path"]


def folded(found: DataFrame, path: str, by: list[str], carried: list[Column]) -> DataFrame:
    """by, word, m (see merges; null for words over MAX_WORD) and the carried aggregates.

    found has word and the columns named by `by`; where it is dealt by one of these, nothing is shuffled.
    """
    ends = F.expr("shiftleft(1L, s) | shiftleft(1L, e)")
    inner = F.expr("(shiftleft(1L, e) - 1L) & ~(shiftleft(1L, s + 1) - 1L)")
    e = edges(found, path).withColumn("edge", F.struct((-F.col("score")).alias("rank"), ends.alias("ends"), inner.alias("inner")))
    # The placeholder of a word's first character has nothing inside and merges nothing.
    e = e.groupBy(*by, "word").agg(F.sort_array(F.collect_list("edge")).alias("edges"), *carried)
    return e.withColumn("m", F.when(F.length("word") <= MAX_WORD, merges(F.col("edges"), F.col("word")))).drop("edges")


def pieces_of(word: str, m: int | None, path: str) -> list[int]:
    """The ids of a word whose boundaries are the bits of m."""
    if m is None:
        return encode_word(word, path)
    pieces, byte, _ = vocabulary(path)
    out, i, m = [], 0, m ^ 1
    while m:
        low = m & -m
        j = low.bit_length() - 1
        p = pieces.get(word[i:j])
        if p:
            out.append(p[0])
        else:
            out += [byte[b] for b in word[i:j].encode()]
        i, m = j, m ^ low
    return out


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): the atoms of all texts."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        def sent(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        c: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                c.update(atoms(t.as_py(), path))
                if len(c) > HELD:
                    yield sent(c)
                    c = Counter()
        yield sent(c)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_atoms(docs: DataFrame, path: str, top: int, sample: int) -> dict[str, list[int]]:
    """The ids of the `top` most frequent atoms of about `sample` documents, chosen by a hash of the id.

    These save work and change no result: atoms that are not among them go through the lattice with their document.
    """
    every = max(1, docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    found = distinct_words(some, path).orderBy(F.desc("n"), "word").limit(top).select("word").repartition("word")
    rows = folded(found, path, [], []).select("word", "m").toArrow()
    return {w: pieces_of(w, m, path) for w, m in zip(rows["word"].to_pylist(), rows["m"].to_pylist(), strict=True)}


def text_key(text: str | None) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"))).view(np.int64))


def encode_documents(docs: DataFrame, model: str | None = None, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and key (a hash of the text) of every document."""
    return encoded(docs, model or default_model(), top, sample, lambda key, ids: (key, ids.tobytes()), "key long, ids binary")


def encoded(docs: DataFrame, path: str, top: int, sample: int, finish: Callable[[int, np.ndarray], tuple], columns: str) -> DataFrame:
    """doc_id and the columns that finish(key, ids) makes, in the process that puts the ids together."""
    spark = docs.sparkSession
    kind16 = len(vocabulary(path)[2]) < 0xFFFF
    unit = np.uint16 if kind16 else np.uint32
    hole = np.array([np.iinfo(unit).max], unit)
    table = {w: np.array(i, unit).tobytes() for w, i in frequent_atoms(docs, path, top, sample).items()}
    shared = spark.sparkContext.broadcast(table)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        get, mark = shared.value.get, hole.tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            for a in range(0, b.num_rows, 512):
                keys, sent, asked, rare = [], [], [], []
                for t in b.column(1).slice(a, 512).to_pylist():
                    ws = atoms(t, path)
                    ids, place = list(map(get, ws)), {}
                    at = [i for i, x in enumerate(ids) if x is None]
                    order = [place.setdefault(ws[i], len(place)) for i in at]
                    for i in at:
                        ids[i] = mark
                    keys.append(text_key(t))
                    sent.append(pack(b"".join(ids)))
                    asked.append(pack(np.array(order, np.uint32).tobytes()))
                    rare.append(list(place))
                columns = [b.column(0).slice(a, 512), pa.array(keys, pa.int64()), pa.array(sent, pa.binary()), pa.array(asked, pa.binary()), pa.array(rare, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "sent", "asked", "rare"])

    part = d.mapInArrow(run, f"doc_id {kind}, key long, sent binary, asked binary, rare array<string>")
    # The one shuffle. A copy of a text under another id has another place, so groups of copies are spread.
    part = part.withColumn("deal", F.xxhash64("doc_id", "key")).repartition("deal")
    own = F.struct(F.lit(-1).alias("r"), F.lit(None).cast("string").alias("word"), F.struct("key", "sent", "asked").alias("doc"))
    atom = lambda w, r: F.struct(r.alias("r"), w.alias("word"), F.lit(None).cast(part.select(F.struct("key", "sent", "asked").alias("doc")).schema["doc"].dataType).alias("doc"))
    rows = part.select("deal", "doc_id", F.explode(F.concat(F.array(own), F.transform("rare", atom))).alias("x")).select("deal", "doc_id", "x.r", "x.word", "x.doc")
    m = folded(rows, path, ["deal", "doc_id", "r"], [F.first("doc", ignorenulls=True).alias("doc"), F.sum(F.col("doc").isNotNull().cast("int")).alias("copies")])
    patch = F.collect_list(F.when(F.col("r") >= 0, F.struct("r", "word", "m")))
    j = m.groupBy("deal", "doc_id").agg(F.first("doc", ignorenulls=True).alias("doc"), F.max("copies").alias("copies"), patch.alias("patch"))
    j = j.select("doc_id", "doc.key", "doc.sent", "doc.asked", "copies", "patch")

    made = spark.createDataFrame([], columns).schema

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        unpack, target = zstandard.ZstdDecompressor().decompress, to_arrow_schema(made)
        for b in batches:
            for a in range(0, b.num_rows, 64):
                rows, places, out = b.slice(a, 64), [], []
                patches = rows.column(5)
                first = [0, *itertools.accumulate(n or 0 for n in patches.value_lengths().to_pylist())]
                rs, ws, ms = (patches.flatten().field(i).to_pylist() for i in range(3))
                for k in range(rows.num_rows):
                    key, s, o, c = (rows.column(i)[k].as_py() for i in range(1, 5))
                    ids = np.frombuffer(unpack(s), unit).astype(np.uint32)
                    if first[k + 1] > first[k]:
                        of = {rs[x]: np.array(pieces_of(ws[x], ms[x], path), np.uint32) for x in range(first[k], first[k + 1])}
                        at = np.flatnonzero(ids == hole[0])
                        cuts = [0, *(at + 1)]
                        parts = [x for i, r in enumerate(np.frombuffer(unpack(o), np.uint32).tolist()) for x in (ids[cuts[i] : at[i]], of[r])]
                        ids = np.concatenate([*parts, ids[cuts[-1] :]])
                    places += [k] * c
                    out += [finish(key, ids)] * c
                values = [pa.array([x[i] for x in out], f.type) for i, f in enumerate(target)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(places, pa.int32())), *values], names=["doc_id", *target.names])

    return j.mapInArrow(fill, f"doc_id {kind}, {columns}")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with text."""
    path = model or default_model()
    from pyspark.sql import types as T

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index("ids")
            texts = [decode(np.frombuffer(i, np.uint32).tolist(), path) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def digest_documents(docs: DataFrame, model: str | None = None, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip (whether the ids decode to the text) of every document."""
    path = model or default_model()

    def finish(key: int, ids: np.ndarray) -> tuple:
        return len(ids), zlib.crc32(ids.tobytes()), text_key(decode(ids.tolist(), path)) == key

    return encoded(docs, path, top, sample, finish, "n_pieces long, ids_crc32 long, round_trip boolean")
