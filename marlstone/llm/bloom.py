"""A Bloom filter of fixed size over 64-bit ids: it spares shuffling rows that cannot match, and decides nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import shuffles_dropped

BITS = 1 << 23
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64)
        out = []
        for s in _SEEDS:
            h = (x ^ (x >> np.uint64(31))) * np.uint64(s)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((h >> np.uint64(20)) & np.uint64(bits - 1) if bits & (bits - 1) == 0 else (h >> np.uint64(20)) % np.uint64(bits)).astype(np.int64))
        return out


def build(ids: DataFrame, id_col: str, bits: int = BITS) -> np.ndarray:
    """The filter as uint64 words. At most bits / 64 rows come to the driver, whatever the number of ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = np.zeros(bits // 64, np.uint64)
        for b in batches:
            for p in _places(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "bits"])

    rows = ids.select(F.col(id_col).cast("long").alias("id")).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    with shuffles_dropped(ids.sparkSession):
        got = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return words


def maybe(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    hit = np.ones(len(ids), bool)
    for p in _places(ids, 64 * len(words)):
        hit &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit
