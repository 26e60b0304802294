"""Splitting chunks that are too long for an embedding model: by paragraphs, by table rows, and by force.

Fixed limits: CHARS characters and TOKENS approximate tokens (a third of the characters, or the words, whichever is more).
Rows within the limits pass as they are; each of the others becomes its pieces with the id of its parent and a number, in the
one pass over the chunks. Two ways of splitting are offered, as two stages use them: `embed_limits` cuts plain text at the first
separator that helps and keeps all pieces; `guard` packs paragraphs and leaves out pieces that are still too long, which
`dropped` counts. Tables are packed row by row under their repeated header.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from marlstone.functions import text as T
from marlstone.operators.chunk import recursive_split

#: Fixed limits, the size and the overlap of pieces, and what stands between parts.
CHARS, TOKENS, SAFE, OVERLAP = 4000, 1500, 3500, 150
SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")
#: Characters of pieces that a task holds before it passes them on.
HELD = 1 << 20
TABLE_KINDS = ("table", "pdf_table", "pricing")
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
RULE = re.compile(r"\|?\s*:?-{3,}")


def words(text: str) -> int:
    """The number of WORD's words: bytes are split at the same six characters, and faster."""
    return len(text.encode().split())


def within(chars: int, n_words: int) -> bool:
    return chars <= CHARS and max(chars // 3, n_words) <= TOKENS


def fits(text: str) -> bool:
    """Words are counted only where there can be too many."""
    return len(text) <= CHARS and within(len(text), words(text) if len(text) > 2 * TOKENS else 0)


def tidy(text: str) -> str:
    """Spaces of all kinds to one, blank lines to one, no white space at the ends."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\u00a0", " "))).strip()


def text_pieces(text: str, size: int, overlap: int) -> list[str]:
    """recursive_split with the size held to CHARS and the overlap to a third of it."""
    size = min(size, CHARS)
    return recursive_split(text, size, min(overlap, max(0, size // 3)))


def by_force(pieces: list[str]) -> list[str]:
    """pieces, those over the limits cut every SAFE characters; blank ones go."""
    cut = [x for p in pieces for x in ([p] if fits(p) else [p[i : i + SAFE] for i in range(0, len(p), SAFE)])]
    return [x for x in cut if x.strip()]


def plain_pieces(text: str) -> list[str]:
    """A text within the limits as it is; else pieces of SAFE characters."""
    if fits(text):
        return [text]
    return by_force(recursive_split(text, SAFE, OVERLAP, SEPARATORS))


def packed(parts: list[str], grown: Callable) -> Iterator[list[str]]:
    """parts in runs, each as long as the text of the run fits; a part that doesn't fit alone is a run of its own.

    grown(size, part) adds a part to a run's size (characters and words; None before the first) and returns the new size
    and that of the text that ends there. So each part is measured once or twice, however long its run is.
    """
    held: list[str] = []
    size = None
    for p in parts:
        new, ended = grown(size, p)
        if held and not within(*ended):
            yield held
            held, new = [], grown(None, p)[0]
        held.append(p)
        size = new
    if held:
        yield held


def rows_under(head: str, trim: bool) -> Callable:
    """For packed: lines under head; with trim the text has no white space at its ends."""
    head = head.lstrip() if trim else head
    start = len(head), words(head)

    def grown(size, row):
        n, w = size or start
        full = n + 1 + len(row), w + words(row)
        end = row.rstrip() if trim else row
        return full, full if len(end) == len(row) else (n + 1 + len(end), w + words(end))

    return grown


def paragraphs_in_a_row(size: tuple | None, p: str) -> tuple:
    """For packed: paragraphs with nothing between them, where the first word may go on from the paragraph before; none has
    white space at its end, and the text none at its start."""
    if size is None:
        p = p.lstrip()
    n, w = size or (0, 0)
    full = n + len(p), w + words(p) - (1 if size and WORD.match(p) else 0)
    return full, full


def _table(text: str) -> tuple[list[str], list[str]]:
    lines = [x for x in text.splitlines() if x.strip()]
    return [x for x in lines if "|" in x], [x for x in lines if "|" not in x]


def table_pieces(markdown: str) -> list[str]:
    """Rows packed under the repeated header and the lines outside the table; a row too long alone is cut under the header.

    The second line with a bar counts as the rule under the header, also where it isn't one and a rule is put in its place.
    """
    markdown = tidy(markdown)
    table, outside = _table(markdown)
    if fits(markdown):
        return [markdown]
    if len(table) < 3:
        return plain_pieces(markdown)
    head = [table[0], table[1] if RULE.search(table[1]) else " | ".join(["---"] * max(1, table[0].count("|") + 1))]
    before = "\n".join(outside).strip()
    body = lambda rows: "\n".join([*head, *rows])
    whole = lambda rows: tidy(f"{before}\n\n{body(rows)}" if before else body(rows))
    out = []
    for rows in packed(table[2:], rows_under(f"{before}\n\n{body([])}" if before else body([]), True)):
        if len(rows) == 1 and not fits(body(rows)):
            out += [tidy(body([part])) for part in plain_pieces(rows[0])]
        else:
            out.append(whole(rows))
    return [p for p in out if p.strip()]


def guard_plain(text: str) -> list[str]:
    """Paragraphs packed, with nothing between them; those over the limits cut by force."""
    paragraphs = [p.rstrip() for p in re.split(r"\n\n+", text) if p.strip()]
    whole = lambda run: "".join(run).strip()
    return by_force([whole(run) for run in packed(paragraphs, paragraphs_in_a_row)])


def guard_table(markdown: str) -> list[str]:
    """Rows packed under their first two lines; what is still too long is cut as plain text, each part without a bar under the header."""
    if fits(markdown):
        return [markdown]
    table, _ = _table(markdown)
    if len(table) < 3:
        return guard_plain(markdown)
    body = lambda rows: "\n".join([*table[:2], *rows])
    out = []
    for rows in packed(table[2:], rows_under(body([]), False)):
        p = body(rows)
        out += [p] if fits(p) else [x if "|" in x else body([x]) for x in guard_plain(p)]
    return out


def _split(chunks: DataFrame, pieces: dict[bool, Callable[[str], list[str]]], whole: bool) -> DataFrame:
    """Rows over the limits as their pieces, with `parent` and `sub` and, if not whole, only the fitting pieces and `dropped`."""
    d = chunks.withColumn("_table", F.coalesce(F.col("chunk_type").isin(*TABLE_KINDS) & F.col("content").contains("|"), F.lit(False)))
    d = d.withColumn("_ok", F.coalesce(T.within_embed_limit(F.col("content"), CHARS, TOKENS), F.lit(True)))
    d = d.withColumn("parent", F.when(~F.col("_ok"), F.coalesce("chunk_id", F.substring(F.sha2("content", 256), 1, 16))))
    names = d.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        at, kind, ok = names.index("content"), names.index("_table"), names.index("_ok")

        def made(b, rows: list[tuple]):
            index = pa.array([r[0] for r in rows], pa.int64())
            columns = [pa.array([r[2] for r in rows], pa.string()) if j == at else c.take(index) for j, c in enumerate(b.columns)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=[*names, "sub", "dropped"])

        for whole_batch in batches:
            same = whole_batch.filter(whole_batch.column(ok))
            if len(same):
                yield pa.RecordBatch.from_arrays([*same.columns, pa.nulls(len(same), pa.int32()), pa.array([0] * len(same), pa.int32())], names=[*names, "sub", "dropped"])
            b = whole_batch.filter(pc.invert(whole_batch.column(ok)))
            rows, n = [], 0
            for i, (text, is_table) in enumerate(zip(b.column(at), b.column(kind), strict=True)):
                every = pieces[is_table.as_py()](text.as_py())
                some = [(k, p) for k, p in enumerate(every) if whole or fits(p)]
                lost = len(every) - len(some)
                if not some:
                    some = [(None, None)]  # the row stands for what was dropped
                rows += [(i, k, p, lost if j == 0 else 0) for j, (k, p) in enumerate(some)]
                n += sum(len(p or "") for _, p in some)
                if n >= HELD:
                    yield made(b, rows)
                    rows, n = [], 0
            if rows:
                yield made(b, rows)

    schema = P.StructType([*d.schema.fields, P.StructField("sub", P.IntegerType()), P.StructField("dropped", P.IntegerType())])
    return d.mapInArrow(run, schema).select(*chunks.columns, "sub", "dropped", "parent")


def _hash16(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def chunk_id(url: Column, page: Column, kind: Column, section: Column, index: Column, content: Column) -> Column:
    """The first 16 digits of a hash of where a chunk stands and what it says; a page that is missing reads None."""
    return _hash16(F.concat_ws("|", url, F.coalesce(page.cast("string"), F.lit("None")), kind, section, index.cast("string"), _hash16(content)))


def embed_limits(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, source_url, page, chunk_type, section_title, content and others) within the limits, as far as SAFE
    characters are; pieces get parent, sub and an id of their own."""
    d = _split(chunks, {True: table_pieces, False: plain_pieces}, True).drop("dropped")
    own = chunk_id(F.coalesce("source_url", F.lit("")), F.col("page"), F.coalesce("chunk_type", F.lit("")), F.coalesce("section_title", F.lit("")), F.col("sub"), F.concat_ws("|", "parent", "content"))
    return d.withColumn("chunk_id", F.when(F.col("sub").isNull(), F.col("chunk_id")).otherwise(own))


def guard(chunks: DataFrame) -> DataFrame:
    """Like embed_limits, by paragraphs, and nothing stays over the limits: `dropped` counts the pieces left out, on the first
    row of a chunk's pieces, or on a row without content where none is left."""
    d = _split(chunks, {True: guard_table, False: guard_plain}, False)
    own = _hash16(F.concat_ws(":", "parent", F.lit("sub"), F.col("sub").cast("string"), _hash16(T.stripped(F.col("content")))))
    return d.withColumn("chunk_id", F.when(F.col("sub").isNull(), F.when(F.col("parent").isNull(), F.col("chunk_id"))).otherwise(own))
