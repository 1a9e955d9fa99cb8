"""Shared pieces of the training-data operators: shared-folder checkpoints, word tokenising, ragged arrays."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 6 << 20


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Where none is named, a local session (tests on one machine) takes a new one; on a cluster executors couldn't share it, so that is an error."""
    if spark.sparkContext.getConf().get("spark.checkpoint.dir") is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs nothing upstream."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows, by reading no more than limit + 1 of them to count."""
    return df.limit(limit + 1).count() <= limit


def row_key(*columns: str):
    """64-bit identity of a document row, from its id and text. Equal rows share it and count as one document."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def row_check(*columns: str):
    """Another 64 bits of identity, by another seed: at 10 ** 10 rows some pairs of different rows share one half, none both."""
    return F.xxhash64(F.lit("check"), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of df has already (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


@functools.cache
def thrifty() -> None:
    """Make this Python worker give freed memory back: workers live on between stages, and an executor has several."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        mallopt = ctypes.CDLL("libc.so.6").mallopt
    except (OSError, AttributeError):  # another C library: nothing to set
        return
    mallopt(-3, 1 << 20)  # blocks from 1 MB on are mapped, so that freeing unmaps them
    mallopt(-1, 1 << 20)  # the heap's end is trimmed from 1 MB on


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows that hold about limit bytes of text; a longer text stays whole."""
    thrifty()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def offsets_of(lists: pa.Array) -> np.ndarray:
    """Offsets of a list array, from 0, whatever slice it is."""
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return off - off[0]


def hashes(words: list[str | None]) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w) if w is not None else 0 for w in words), np.uint64, len(words))


def word_codes(text: pa.Array, prepare: Callable[[str], str] | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, codes): for each text the 64-bit codes of its words, split at white space.

    A null text has no words. prepare rewrites each distinct word first; words that it makes empty are left out.
    """
    text = pc.fill_null(text.cast(pa.string()), "")
    if lower:
        text = pc.utf8_lower(text)
    lists = pc.utf8_split_whitespace(text)
    off = offsets_of(lists)
    coded = lists.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.to_pylist()
    keep = np.fromiter((w != "" for w in words), bool, len(words))
    if prepare is not None:
        words = [prepare(w) for w in words]
        keep &= np.fromiter((w != "" for w in words), bool, len(words))
    code = hashes(words)
    if len(keep) and not keep.all():
        mask = keep[index]
        off = np.concatenate([[0], np.cumsum(mask)])[off]
        index = index[mask]
    return off, code[index] if len(code) else np.zeros(0, np.uint64)


def spread(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged offsets: the row of each element, and its position in that row."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(off[-1]) - off[:-1][row]


def ragged_take(off: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the given rows of a ragged array, in that order."""
    n = np.diff(off)[rows]
    out = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(out[-1]) + np.repeat(off[:-1][rows] - out[:-1], n)
    return out, values[at]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base & (2**64 - 1)
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(step)
            have += more
            step = step * step & (2**64 - 1)
    return out[:n]


def window_prints(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of each run of width codes: a rolling polynomial hash modulo 2 ** 64, scrambled."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    inverse = pow(_BASE, -1, 2**64)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * _powers(n, _BASE), dtype=np.uint64)])
        raw = (total[width:] - total[:-width]) * _powers(n - width + 1, inverse)
    return mix(raw)
