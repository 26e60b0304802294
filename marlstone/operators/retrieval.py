"""Sparse and dense retrieval, fusion, boosts, guards and caps. Every ranking has a total order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as P

from marlstone.functions import text as T
from marlstone.streaming.folders import shuffles_dropped, stored

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Most query terms, and most query vectors, that are broadcast; more are joined by a shuffle.
MOST_TERMS, MOST_VECTORS = 100_000, 2048
#: Most sums that a task adds up at once; how many tokens it counts at once, as far as texts can be parted; texts whose hits it merges at once.
SUMS, TOKENS, ROWS = 1 << 21, 1 << 22, 2048


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, dl): one row for each term of a document, counted where it is read."""
    d = docs.select(F.col(id_col).alias("id"), T.index_tokens(F.col(text_col)).alias("t"))
    return d.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, qtf): terms asked for more than once weigh so often."""
    q = queries.select(F.col(id_col).alias("qid"), F.explode(T.index_tokens(F.col(text_col))).alias("term"))
    return q.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def split_tokens(x: Column) -> Column:
    """T.index_tokens by a split, which is faster; an empty text can be at each end."""
    return F.split(F.lower(x), r"[^\p{L}\p{N}_]+")


def n_tokens(t: str) -> Column:
    """The number of split_tokens' tokens."""
    first, last = F.get(t, F.lit(0)) == "", (F.size(t) > 1) & (F.get(t, F.size(t) - 1) == "")
    return F.size(t) - first.cast("int") - last.cast("int")


def _flat(b, tokens: str) -> Iterator[tuple]:
    """(first row, dl, row of each token, tokens) of slices of a batch with split_tokens' lists; the empty tokens are left out."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(tokens)), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(ends // TOKENS)) + 1), len(b)]
    for a, z in zip(cuts, cuts[1:]):
        lists = b.column(tokens).slice(a, z - a)
        row = pc.list_parent_indices(lists).to_numpy()
        flat = pc.list_flatten(lists)
        some = pc.greater(pc.binary_length(flat), 0)
        row, flat = row[some.to_numpy(zero_copy_only=False)], flat.filter(some)
        yield a, np.bincount(row, minlength=len(lists)), row, flat


def _runs(row, no, n: int) -> tuple:
    """(row, no, times) of the different pairs, in their order; no is below n."""
    import numpy as np

    key = np.sort(row.astype(np.int64) * n + no)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first] // n, key[first] % n, np.diff(np.r_[first, len(key)])


def _counted(batches: Iterator) -> Iterator:
    """Batches of lists of tokens to (term, df, dl) of each slice, where the row without term has the slice's documents and lengths."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for a, dl, row, flat in _flat(b, "t"):
            code = flat.dictionary_encode()
            n = len(code.dictionary)
            df = np.bincount(_runs(row, code.indices.to_numpy(), max(n, 1))[1], minlength=n)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([code.dictionary, pa.nulls(1, pa.string())]), pa.array(np.r_[df, len(dl)], pa.int64()), pa.array(np.r_[np.zeros(n, np.int64), dl.sum()], pa.int64())], names=["term", "df", "dl"])


def corpus_terms(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df, dl): the documents that hold each term; the row without term has their number and summed lengths.

    One pass over the texts, counted in arrays where they are read: a token is never a row."""
    t = docs.select(split_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return t.mapInArrow(_counted, "term string, df long, dl long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def term_idf(terms: DataFrame) -> DataFrame:
    """(term, df, idf) of corpus_terms: Okapi's idf; a negative one becomes FLOOR times the mean. One-row tables are broadcast."""
    n = terms.where("term is null").select(F.col("df").alias("n"))
    t = terms.where("term is not null").crossJoin(F.broadcast(n))
    t = t.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = t.agg(F.avg("raw").alias("mean"))
    return t.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", q_id: str = "item_id", q_text: str = "text", idf_cap: int | None = None, best: int | None = None) -> DataFrame:
    """(qid, id, score), rounded to 6 places, of every document that shares a term with the query.
    idf_cap keeps only so many terms of each query, those of the highest idf. best: see hits_scored."""
    return bm25_lists(docs, queries, (idf_cap,), id_col, text_col, q_id, q_text, best).drop("list")


def bm25_lists(docs: DataFrame, queries: DataFrame, caps: tuple[int | None, ...], id_col: str = "doc_id", text_col: str = "text", q_id: str = "item_id", q_text: str = "text", best: int | None = None) -> DataFrame:
    """(list, qid, id, score) of bm25 with each of caps, whose place is the list's number.

    The texts are read twice, however many caps there are: for the terms' statistics, and for the queries' terms. Up to
    MOST_TERMS query terms are found and counted in arrays where the texts are read (see texts_scored); for more, the texts
    are dealt by document, and their tokens joined.
    """
    corpus = corpus_terms(docs, text_col)
    avgdl = corpus.where("term is null").select((F.col("dl") / F.col("df")).alias("avgdl"))
    base = stored(query_terms(queries, q_id, q_text).join(term_idf(corpus), "term").crossJoin(F.broadcast(avgdl)), "query-terms")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("idf", 9)), "term")
    terms = None
    for i, cap in enumerate(caps):
        own = base.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).drop("r") if cap else base
        own = own.select(F.lit(i).alias("list"), "qid", "term", (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl")
        terms = own if terms is None else terms.unionByName(own)
    return texts_scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), terms, best)


def texts_scored(texts: DataFrame, terms: DataFrame, best: int | None = None) -> DataFrame:
    """hits_scored of texts (id, text), with a row of each text that is hit, and its hits as arrays, instead of rows of tokens.
    Only these are shuffled, by document, as an id may have several texts; the sums are made there."""
    asked = terms.limit(MOST_TERMS + 1).collect()
    if len(asked) > MOST_TERMS:
        d = texts.repartition("id").select("id", split_tokens(F.col("text")).alias("t"))
        return hits_scored(d.select("id", n_tokens("t").alias("dl"), F.explode("t").alias("term")), terms, None, best)
    names = sorted({r.term for r in asked})

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(names, pa.string())
        for b in batches:
            for a, dl, row, flat in _flat(b, "t"):
                no = pc.index_in(flat, value_set=known)
                hit = no.is_valid().to_numpy(zero_copy_only=False)
                at, no, tf = _runs(row[hit], no.drop_null().to_numpy(), max(len(names), 1))
                n = np.bincount(at, minlength=len(dl))
                some = np.flatnonzero(n)
                start = pa.array(np.r_[0, np.cumsum(n[some])], pa.int32())
                lists = (pa.ListArray.from_arrays(start, pa.array(x, pa.int32())) for x in (no, tf))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(a + some)), pa.array(dl[some], pa.int32()), *lists], names=["id", "dl", "no", "tf"])

    arrays = P.ArrayType(P.IntegerType())
    fields = [texts.schema["id"], P.StructField("dl", P.IntegerType()), P.StructField("no", arrays), P.StructField("tf", arrays)]
    hits = texts.select("id", split_tokens(F.col("text")).alias("t")).mapInArrow(found, P.StructType(fields))
    return _added(hits.repartition("id"), asked, terms, names, best, True)


def hits_scored(tokens: DataFrame, terms: DataFrame, tf: str | None, best: int | None = None) -> DataFrame:
    """(list, qid, id, score): the sums over what terms (list, qid, term, weight, avgdl) hit of tokens (id, dl, term), which are
    dealt by id; tf is their column of counts, or each row counts once.

    Up to MOST_TERMS terms come to every task as arrays: it sorts its hits by document and adds up the documents one after
    another, so that it holds few sums at a time, and a hit isn't multiplied by its queries in rows. More are joined and
    grouped. best: only a list's best so many are wanted; documents that a task knows to be behind as many others, ties of
    the rounded score left aside, can be missing then, and the rest still has to be ranked.
    """
    spark = tokens.sparkSession
    count = F.sum(tf) if tf else F.count("*")
    asked = terms.limit(MOST_TERMS + 1).collect()
    if len(asked) > MOST_TERMS:
        posts = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "dl").agg(count.alias("tf"))
        return summed(posts.join(terms, "term"), "list")
    names = sorted({r.term for r in asked})
    known = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "term string, no int")
    hits = tokens.join(F.broadcast(known), "term").groupBy("id", "dl", "no").agg(count.cast("long").alias("tf"))
    return _added(hits, asked, terms, names, best, False)


def _added(hits: DataFrame, asked: list, terms: DataFrame, names: list[str], best: int | None, lists: bool) -> DataFrame:
    """(list, qid, id, score) of hits (id, dl, no, tf), dealt by id; asked are the rows of terms, names the terms by their numbers."""
    spark, numbers = hits.sparkSession, {t: i for i, t in enumerate(names)}
    queries = {q: i for i, q in enumerate(dict.fromkeys((r.list, r.qid) for r in asked))}
    asked.sort(key=lambda r: numbers[r.term])
    of = [numbers[r.term] for r in asked]
    add = _adder(of, [queries[r.list, r.qid] for r in asked], [r.weight for r in asked], len(numbers), len(queries), asked[0].avgdl if asked else None, best)
    run = (lambda batches: add(_unlisted(batches))) if lists else add
    got = hits.sortWithinPartitions("id").mapInArrow(run, P.StructType([P.StructField("q", P.IntegerType()), P.StructField("id", hits.schema["id"].dataType), P.StructField("s", P.DoubleType())]))
    back = spark.createDataFrame([(i, n, q) for (n, q), i in queries.items()], P.StructType([P.StructField("q", P.IntegerType()), P.StructField("list", P.IntegerType()), P.StructField("qid", terms.schema["qid"].dataType)]))
    return got.join(F.broadcast(back), "q").select("list", "qid", "id", F.round("s", 6).alias("score"))


def _whole(batches: Iterator) -> Iterator:
    """The batches, sorted by id, cut so that all rows of an id are in one of them."""
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        if not len(b):
            continue
        code = b.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(code == code[-1])[0])  # the last document may go on in the next batch
        if cut:
            yield b.slice(0, cut)
        held = b.slice(cut)
    if held is not None and len(held):
        yield held


def _unlisted(batches: Iterator) -> Iterator:
    """Batches (id, dl, no, tf) with no and tf as lists, sorted by id, to one row for each id, dl and no, with the summed tf."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in _whole(b.slice(a, ROWS) for b in batches for a in range(0, len(b), ROWS)):
        row, no, tf = pc.list_parent_indices(whole.column("no")).to_numpy(), pc.list_flatten(whole.column("no")).to_numpy(), pc.list_flatten(whole.column("tf")).to_numpy()
        doc = whole.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        dl = whole.column("dl").to_numpy()
        if (doc[1:] == doc[:-1]).any():  # several texts of an id: those of one length count together
            order = np.lexsort((no, dl[row], doc[row]))
            row, no, tf = row[order], no[order], tf[order]
            same = (no[1:] == no[:-1]) & (dl[row[1:]] == dl[row[:-1]]) & (doc[row[1:]] == doc[row[:-1]])
            first = np.flatnonzero(np.r_[True, ~same])
            row, no, tf = row[first], no[first], np.add.reduceat(tf, first)
        yield pa.RecordBatch.from_arrays([whole.column("id").take(pa.array(row)), pa.array(dl[row]), pa.array(no), pa.array(tf.astype(np.int64))], names=["id", "dl", "no", "tf"])


def _adder(of: list[int], query: list[int], weight: list[float], n_terms: int, n_queries: int, avgdl: float | None, best: int | None):
    """Batches of hits (id, dl, no, tf), sorted by id, to (q, id, s); of, query and weight are the terms' parts in the terms' order."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        start = np.searchsorted(np.array(of, np.int64), np.arange(n_terms + 1))
        q, w = np.array(query, np.int64), np.array(weight, np.float64)
        top = np.full((best, n_queries), -np.inf) if best and best * n_queries <= SUMS else None

        def wanted(sums, hit):
            """Of the places hit those that can be among the best: not 2e-6 under the least of as many seen before."""
            seen = np.full(len(sums), -np.inf)
            seen[hit] = sums[hit]
            top[:] = np.partition(np.concatenate([top, seen.reshape(-1, n_queries)]), -best, axis=0)[-best:]
            return hit[sums[hit] >= top.min(axis=0)[hit % n_queries] - 2e-6]

        def added(b):
            """Sums of whole documents."""
            code = b.column("id").dictionary_encode(null_encoding="encode")
            doc = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            no, tf, dl = (b.column(c).to_numpy(zero_copy_only=False) for c in ("no", "tf", "dl"))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            each = start[no + 1] - start[no]
            ends = np.cumsum(each)
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])  # where a document starts
            most = max(1, SUMS // n_queries)
            i = 0
            while i < len(first):
                j = i + 1
                while j < len(first) and j - i < most and ends[(first[j + 1] if j + 1 < len(first) else len(doc)) - 1] - (ends[first[i] - 1] if first[i] else 0) <= SUMS:
                    j += 1
                rows = slice(first[i], first[j] if j < len(first) else len(doc))
                n = each[rows]
                of_row = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of_row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[no[rows]], n)
                key = (doc[rows][of_row] - doc[first[i]]) * n_queries + q[at]
                size = (j - i) * n_queries
                sums, hit = np.bincount(key, w[at] * part[rows][of_row], size), np.flatnonzero(np.bincount(key, minlength=size))
                hit = hit if top is None else wanted(sums, hit)
                ids = code.dictionary.take(pa.array(doc[first[i]] + hit // n_queries))
                yield pa.RecordBatch.from_arrays([pa.array(hit % n_queries, pa.int32()), ids, pa.array(sums[hit])], names=["q", "id", "s"])
                i = j

        for b in _whole(batches):
            yield from added(b)

    return run


def summed(hit: DataFrame, *by: str) -> DataFrame:
    """(*by, qid, id, score) of postings (id, tf, dl) that were hit by (qid, weight), with avgdl."""
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(*by, "qid", "id").agg(F.round(F.sum(part), 6).alias("score"))


def padded(scored: DataFrame, docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", q_id: str = "item_id") -> DataFrame:
    """scored with documents of score 0, those of the smallest ids, so that every query has k rows if there are so many.

    The k smallest ids are enough for any query, and all that the driver gets; so the documents that are scored once more,
    to see which of them have a score, are at most k."""
    ids = [r[0] for r in docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy("id").limit(k).collect()]
    first = F.array(*map(F.lit, ids)).cast(f"array<{scored.schema['id'].dataType.simpleString()}>")
    more = queries.select(F.col(q_id).alias("qid")).distinct().select("qid", F.explode(first).alias("id"))
    has = scored.where(F.col("id").isin(ids)).select("qid", "id")
    return scored.unionByName(more.join(has, ["qid", "id"], "left_anti").withColumn("score", F.lit(0.0)))


def ranked(scored: DataFrame, k: int, query: str = "qid", item: str = "id", score: str = "score") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def capped(scored: DataFrame, by: str, cap: int, k: int, query: str = "qid", item: str = "id", score: str = "score") -> DataFrame:
    """At most cap of each source in rank order, then the k best."""
    w = Window.partitionBy(query, by).orderBy(F.desc(score), F.asc(item))
    return ranked(scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r"), k, query, item, score)


def guarded(df: DataFrame, keep: Column, query: str = "qid") -> DataFrame:
    """Filters a query's rows only if the filter leaves some."""
    w = Window.partitionBy(query)
    return df.withColumn("_any", F.max(keep.cast("int")).over(w)).where((F.col("_any") == 0) | keep).drop("_any")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): each query vector's k nearest by cosine, rounded to 6 places, itself excepted.

    A stated query set against all rows: up to MOST_VECTORS queries come to the vectors, which stay where they are read,
    as a broadcast, and more of them one such block after the other, so that no vector is ever shuffled. A product of
    matrices tells which pairs can be among a task's best, only these are added up in order, in arrays (pairs with an odd
    vector by Spark's functions), and a block's best are written before the next block starts.
    """
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))))
    v = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))

    def nearest(asked: DataFrame) -> DataFrame:
        j = _near(v, asked, k).select("id", "e", F.explode(F.arrays_zip("at", "s")).alias("n")).select("id", "e", "n.at", "n.s").join(F.broadcast(_numbered(asked, unit)), F.col("at") == F.col("n")).where("id <> qid")
        folded = F.aggregate(F.zip_with(unit(F.col("e")), "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return j.select("qid", "id", F.round(F.coalesce("s", folded), 6).alias("score"))

    if queries.select("vec_id").limit(MOST_VECTORS + 1).count() <= MOST_VECTORS:
        return ranked(nearest(queries), k)
    out = None
    with shuffles_dropped(queries.sparkSession):
        for asked in _blocks(queries.select("vec_id", "embedding"), max(1, MOST_VECTORS)):
            best = stored(ranked(nearest(asked), k).drop("rank"), "nearest")
            out = best if out is None else out.unionByName(best)
    return ranked(out, k)  # once more, as rows of one query can be in two blocks


def _blocks(rows: DataFrame, most: int) -> Iterator[DataFrame]:
    """The rows, stored once, in blocks of so many: runs of the places that they were written at."""
    at = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "asked")
    block, room = F.lit(False), most
    for r in at.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect():
        first, left = r["part"] << 33, r["count"]
        while left:
            n = min(room, left)
            block = block | F.col("_at").between(first, first + n - 1)
            first, left, room = first + n, left - n, room - n
            if not room:
                yield at.where(block).drop("_at")
                block, room = F.lit(False), most
    if room < most:
        yield at.where(block).drop("_at")


def _numbered(queries: DataFrame, unit) -> DataFrame:
    """(n, qid, qv) of up to MOST_VECTORS queries, numbered in the order that the driver gets them in."""
    got = [(i, r[0], r[1]) for i, r in enumerate(_asked(queries))]
    kinds = queries.select("vec_id", "embedding").schema
    d = queries.sparkSession.createDataFrame(got, P.StructType([P.StructField("n", P.IntegerType()), P.StructField("qid", kinds[0].dataType), P.StructField("e", kinds[1].dataType)]))
    return d.select("n", "qid", unit(F.col("e")).alias("qv"))


def _asked(queries: DataFrame) -> list:
    return sorted(map(tuple, queries.select("vec_id", "embedding").collect()), key=repr)


def _near(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors (id, e) with `at`, the numbers of the queries that each can be among the k nearest of: those not 2e-6 under the
    least of k seen before in its task. Vectors with nulls, zero or non-finite ones, and those of other lengths are at all.
    `s` has their cosines, added up component by component as Spark's functions do, and null where one of both is odd."""
    asked = _asked(queries)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(vs, width):
            out = np.zeros((len(vs), width))
            for i, v in enumerate(vs):
                if v is not None and len(v) == width and None not in v:
                    out[i] = v
            out[~np.isfinite(out).all(axis=1)] = 0
            norm = np.zeros(len(out))
            for x in out.T:
                norm += x * x
            norm = np.sqrt(norm)
            ok = np.isfinite(norm) & (norm > 0)
            out[~ok] = 0
            return out / np.where(ok, norm, 1)[:, None], ok

        width = max((len(e) for _, e in asked if e is not None), default=0)
        q, q_ok = rows([e for _, e in asked], width)
        q_columns = np.ascontiguousarray(q.T)
        own = {}
        for n, (i, _) in enumerate(asked):
            own.setdefault(i, []).append(n)
        top = np.full((k, len(asked)), -np.inf)
        for whole in batches:
            for b in (whole.slice(a, 1024) for a in range(0, len(whole), 1024)):
                v, ok = rows(b.column(1).to_pylist(), width)
                s = v @ q.T
                s[~ok] = -np.inf
                for r, i in enumerate(b.column(0).to_pylist()):
                    s[r, own.get(i, []) if i is not None else slice(None)] = -np.inf
                top = np.partition(np.concatenate([top, s]), -k, axis=0)[-k:]
                keep = (s >= top.min(axis=0) - 2e-6) | ~ok[:, None] | ~q_ok
                r, c = np.nonzero(keep)
                cosine = np.zeros(len(r))
                for x, y in zip(np.ascontiguousarray(v.T), q_columns):
                    cosine += x[r] * y[c]
                off = pa.array(np.r_[0, np.cumsum(keep.sum(axis=1))], pa.int32())
                at, cosines = (pa.ListArray.from_arrays(off, x) for x in (pa.array(c, pa.int32()), pa.array(cosine, mask=~(ok[r] & q_ok[c]))))
                yield pa.RecordBatch.from_arrays([*b.columns, at, cosines], names=["id", "e", "at", "s"])

    return vectors.mapInArrow(run, P.StructType([*vectors.schema.fields, P.StructField("at", P.ArrayType(P.IntegerType())), P.StructField("s", P.ArrayType(P.DoubleType()))]))


def rrf(rankings: list[tuple[DataFrame, float | Column]], k: int = 60) -> DataFrame:
    """(qid, id, score): the sum of weight / (k + rank) over the rankings; a weight can be a column of its ranking."""
    out = None
    for df, w in rankings:
        part = df.select("qid", "id", (F.lit(w) / (k + F.col("rank"))).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("qid", "id").agg(F.round(F.sum("p"), 6).alias("score"))


def prepended(first: DataFrame, rest: DataFrame) -> DataFrame:
    """(qid, id, rank): the first ranking of each query, then the other one with its ranks after it. What is in both stays
    twice, so that rrf adds up both places."""
    n = first.groupBy("qid").agg(F.max("rank").alias("_n"))
    moved = rest.join(n, "qid", "left").select("qid", "id", (F.col("rank") + F.coalesce("_n", F.lit(0))).alias("rank"))
    return first.select("qid", "id", "rank").unionByName(moved)


def chosen_weight(given: Column, default: float, profile: Column) -> Column:
    """The profile's weight where the caller left the default."""
    return F.when(given == default, profile).otherwise(given)


def boosted(df: DataFrame, rules: list[tuple[str, float, Column]]) -> DataFrame:
    """Adds the deltas of the rules that hold to score, and their names in order as reasons."""
    delta = sum((F.when(c, F.lit(d)).otherwise(F.lit(0.0)) for _, d, c in rules), F.lit(0.0))
    names = F.filter(F.array(*(F.when(c, F.lit(n)) for n, _, c in rules)), lambda r: r.isNotNull())
    return df.withColumn("boosted", F.round(F.col("score") + delta, 6)).withColumn("reasons", F.array_join(names, ","))


def expanded(query: Column, synonyms: list[tuple[str, tuple[str, ...]]]) -> Column:
    """The query with the synonyms of the words it holds, each once and only if absent."""
    low = F.lower(query)
    more = F.flatten(F.array(*(F.when(F.contains(low, F.lit(w)), F.array(*(F.lit(s) for s in syn))).otherwise(F.array().cast("array<string>")) for w, syn in synonyms)))
    new = F.filter(F.array_distinct(more), lambda s: ~F.contains(low, s))
    return F.when(F.size(new) > 0, F.concat_ws(" ", query, F.array_join(new, " "))).otherwise(query)
