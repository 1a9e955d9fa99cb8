"""Operator 10: near duplicates by SetSketch registers.

1. A document's set is its runs of SHINGLE words (lower case, without punctuation at their ends). Its sketch has REGISTERS
   registers; register i is floor(1 - log_BASE(x)), cut to [0, TOP], for the least x that the set's elements have under the i-th
   hash, exponentially distributed with rate RATE: the registers of a union are the greater ones of the parts'.
2. Documents with equal sets are put together first, whatever their number. Registers are locality-sensitive: bands of BAND_ROWS register
   values give the candidate buckets.
3. In each bucket every set is a candidate to the bucket's least one (by key). A candidate pair's similarity is estimated jointly, by
   maximum likelihood of the numbers of registers in which it is greater, less and equal; pairs clearly under the threshold go.
4. The most similar candidate of each set is verified on the sets themselves (Jaccard similarity >= THRESHOLD, elements being 32-bit hashes); verified pairs
   make groups. Then, as only one member of a bucket was compared, members of a bucket whose groups still differ are compared too, so that no candidate
   pair is left out that could join groups. No pairs are made for that: a bucket's sketches are dealt out to blocks of up to BLOCK, each two blocks
   are compared by matrix operations, and only pairs with a likely similarity come out. A bucket in which all belong to one group costs nothing more.

Shuffled: sketches (2 bytes a register), 16 bytes a band, sketches of buckets with several groups once for each block of the bucket, and sets only of documents
with a likely partner. Of pairs at the threshold the bands miss one in 22, and the margin one in some thousand (three standard errors); above, fewer.

Results: see groups(). Null, empty and wordless texts have no set and are in no group. Fewer than SHINGLE words make one element of all of
them. Rows equal in id and text count as one document in groups(), and drop_near_copies() keeps one of them. Of a group the least doc_id stays (null only if
there is no other). Similarity exactly at the threshold counts. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, mix, row_check, row_key, slices, small_enough, window_prints, word_codes

SHINGLE, THRESHOLD = 3, 0.5
REGISTERS, BAND_ROWS = 192, 4
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Estimates under THRESHOLD by more than this (over three standard errors) aren't verified.
MARGIN = 0.12
#: Members of a bucket that a task compares with as many others at once.
BLOCK = 4096
#: Keys of documents with a partner, up to this number (8 bytes each), are sent to every executor instead of shuffling all texts.
BROADCAST_ROWS = 1_000_000
_EDGE = "\"'`.,;:!?()[]{}<>|*#%&$@^~=+/\\_-…“”‘’«»¿¡"
#: A text with words, in any script: something other than white space and what is stripped from words.
_WORD = r"(?U)[^\s" + "".join("\\" + c for c in _EDGE) + "]"


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (raw[:n] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (raw[n:] & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def shingles(text: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, elements): 32-bit elements of each text's set, with repetitions."""
    off, codes = word_codes(text, lambda w: w.strip(_EDGE), lower=True)
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    prints = window_prints(codes, k)
    at = np.arange(out[-1]) - np.repeat(out[:-1] - off[:-1], count)
    values = prints[np.minimum(at, max(len(prints) - 1, 0))] if len(prints) else np.zeros(len(at), np.uint64)
    for r in np.flatnonzero((n > 0) & (n < k)).tolist():
        values[out[r]] = mix(np.bitwise_xor.reduce(mix(codes[off[r] : off[r + 1]] + np.arange(n[r], dtype=np.uint64)), keepdims=True))[0]
    return out, (values >> np.uint64(32)).astype(np.uint32)


def sketch(off: np.ndarray, values: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of each non-empty set, a row each."""
    xor, times = _seeds(registers)
    n = len(off) - 1
    least = np.full((n, registers), 0xFFFFFFFF, np.uint32)
    start = 0
    while start < n:  # pieces that stay in the cache
        end = max(start + 1, int(np.searchsorted(off, off[start] + 32768, side="right")) - 1)
        part, heads = values[off[start] : off[end]], off[start:end] - off[start]
        for i in range(registers):
            least[start:end, i] = np.minimum.reduceat((part ^ xor[i]) * times[i], heads)
        start = end
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def _sets(off: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each set's distinct elements, ascending."""
    row = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))
    key = np.unique((row << np.uint64(32)) | values)
    return np.searchsorted(key, np.arange(len(off), dtype=np.uint64) << np.uint64(32)), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", 3 << 20):
        off, values = shingles(part.column("text"))
        off, values = _sets(off, values)
        some = np.flatnonzero(np.diff(off) > 0)
        if not len(some):
            continue
        registers = sketch(np.append(off[some], off[-1]), values)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values.astype(np.uint64)), dtype=np.uint64)])
        content = mix(total[off[1:]] - total[off[:-1]])[some]
        rows = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c).take(rows) for c in ("rid", "check", "doc")), pa.array(content.view(np.int64)), pa.array(np.diff(off)[some].astype(np.int32)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(registers.shape[1] * 2), len(some), [None, pa.py_buffer(registers)]).cast(pa.binary())],
            names=["rid", "check", "doc", "content", "size", "sketch"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 4096):
            part = b.slice(start, 4096)
            m = np.ascontiguousarray(_matrix(part.column("sketch"))).view(np.uint64)
            keys = mix(m ^ mix(np.arange(1, m.shape[1] + 1, dtype=np.uint64)))
            node = np.repeat(part.column("node").to_numpy(), m.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node)], names=["band", "node"])


def likelihood_estimate(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the register comparison most likely, given the sets' sizes; golden-section search."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    scale = (BASE - 1) / BASE

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        more, fewer = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return greater * np.log(more + tiny) + less * np.log(fewer + tiny) + equal * np.log(np.maximum(1 - more - fewer, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        left = value(a) > value(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            b = batch.slice(start, 4096)
            x, y = _matrix(b.column("sketch_a")), _matrix(b.column("sketch_b"))
            sizes = [b.column(n).to_numpy().astype(float) for n in ("size_a", "size_b")]
            j = likelihood_estimate((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), *sizes)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j)], names=["a", "b", "estimate"])


def _likely_in_blocks(least: float):
    """Pairs of the members of two blocks of a bucket, of different groups, with a likely similarity of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            m, node, label, size, second = _matrix(b.column("sketch")), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "size", "second"))
            one = np.flatnonzero(~second)
            two = np.flatnonzero(second) if second.any() else one
            by_size = two[np.argsort(size[two], kind="stable")]
            for i in one.tolist():
                # Similarity is at most the ratio of the sizes.
                j = by_size[np.searchsorted(size[by_size], least * size[i], side="left") : np.searchsorted(size[by_size], size[i] / least, side="right")]
                j = j[label[j] != label[i]] if two is not one else j[(label[j] != label[i]) & (j > i)]
                if not len(j):
                    continue
                equal = (m[j] == m[i]).sum(axis=1)
                j, equal = j[equal >= least * 0.5 * m.shape[1]], equal[equal >= least * 0.5 * m.shape[1]]  # far under what the estimate asks for
                if len(j):
                    more, fewer = (m[i] > m[j]).sum(axis=1), (m[i] < m[j]).sum(axis=1)
                    j = j[likelihood_estimate(more, fewer, equal, np.full(len(j), float(size[i])), size[j].astype(float)) >= least]
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "u", "v")), strict=True))
            start = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[start]:
                    if held and keys[start] != now:
                        yield from work(held)
                        held = []
                    now = keys[start]
                    held.append(batch.slice(start, k - start))
                    start = k
        if held:
            yield from work(held)

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        off, values = _sets(*shingles(part.column("text")))
        data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((off * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
        yield pa.RecordBatch.from_arrays([part.column("node"), data], names=["node", "elements"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ea", 4 << 20):
            good = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("ea").to_pylist(), b.column("eb").to_pylist(), strict=True)):
                one, two = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                shared = len(one) + len(two) - len(np.unique(np.concatenate([one, two])))
                good[k] = shared >= threshold * (len(one) + len(two) - shared)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b); label is the least node of its component.

    Large-star and small-star steps in turn: each node's neighbours are joined to its least one, until nothing changes.
    Rounds grow with the logarithm of the size; each ends in a checkpoint.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        links = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        met = links.join(least, "a")
        if large:
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        pairs = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return pairs.filter("a <> b").distinct()

    now = checkpoint(edges.filter("a <> b").select("a", "b").distinct())
    mark = None
    while True:
        now = checkpoint(star(star(now, True), False))
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def _in_blocks(open_: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """(band, u, v, second, node, label, size, sketch): each two blocks u <= v of each bucket with their members, sorted; second where a member is of block v."""
    sizes = open_.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = open_.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = each.select("band", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), (F.col("own") > F.col("other")).alias("second"), "node", "label")
    return placed.join(nodes.select("node", "size", "sketch"), "node").repartition("band", "u", "v").sortWithinPartitions("band", "u", "v").select("band", "u", "v", "second", "node", "label", "size", "sketch")


def _grouped(df: DataFrame, threshold: float, doc_id: str, text: str, block: int = BLOCK) -> DataFrame:
    """(rid, check, doc, label, n, first) for each distinct document that is in a group of two or more."""
    docs = df.select(row_key(doc_id, text).alias("rid"), row_check(doc_id, text).alias("check"), F.col(text).alias("text"), F.col(doc_id).alias("doc")).filter(F.col("text").isNotNull())
    sketched = checkpoint(docs.mapInArrow(_sketches, f"rid bigint, check bigint, doc {df.schema[doc_id].dataType.simpleString()}, content bigint, size int, sketch binary").dropDuplicates(["rid", "check"]))
    firsts = sketched.groupBy("content", "size").agg(F.min(F.struct("rid", "check")).alias("one")).select("one.rid", "one.check")
    # Numbered as they are written, so that no two sets share a number.
    nodes = checkpoint(firsts.join(sketched.drop("doc"), ["rid", "check"]).withColumn("node", F.monotonically_increasing_id()))
    bands = nodes.select("node", "sketch").mapInArrow(_bands, "band bigint, node bigint")
    bucket = Window.partitionBy("band")
    buckets = checkpoint(bands.withColumn("center", F.min("node").over(bucket)).withColumn("top", F.max("node").over(bucket)).filter("center < top").select("band", "node", "center"))
    least = threshold - MARGIN

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_estimates, "a bigint, b bigint, estimate double").filter(F.col("estimate") >= least)

    def elements(ids: DataFrame) -> DataFrame:
        keys = nodes.join(ids, "node").select("node", "rid", "check")
        chosen = docs.drop("doc").join(F.broadcast(keys) if small_enough(keys, BROADCAST_ROWS) else keys, ["rid", "check"])
        return chosen.select("node", "text").mapInArrow(_elements, "node bigint, elements binary").dropDuplicates(["node"])

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        met = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
        return met.select("a", "b", "ea", "eb").mapInArrow(_verify(threshold), "a bigint, b bigint")

    stars = buckets.filter("node > center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    chances = checkpoint(likely(stars))
    ends = lambda e: e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    best = chances.groupBy("b").agg(F.max(F.struct("estimate", (-F.col("a")).alias("minus"))).alias("x")).select((-F.col("x.minus")).alias("a"), "b")
    edges = checkpoint(verified(best, elements(ends(best))))
    labels = components(edges)
    placed = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    several = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    open_ = checkpoint(placed.join(several, "band", "left_semi"))
    more = checkpoint(_in_blocks(open_, nodes, block).mapInArrow(_likely_in_blocks(least), "a bigint, b bigint").distinct())
    if not more.isEmpty():
        found = verified(more, checkpoint(elements(ends(more))))
        of = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        between = found.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        labels = _relabelled(labels, components(between))
    members = sketched.select("rid", "check", "doc", "content", "size").join(nodes.select("content", "size", "node"), ["content", "size"]).join(labels, "node", "left")
    labelled = members.select("rid", "check", "doc", F.coalesce("label", "node").alias("label"))
    same = Window.partitionBy("label")
    return labelled.withColumn("n", F.count(F.lit(1)).over(same)).filter("n > 1").withColumn("first", F.row_number().over(same.orderBy(F.col("doc").asc_nulls_last(), "rid", "check"))).select("rid", "check", "doc", "label", "n", "first")


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """The groups of labels (node, label) after those of merged, whose nodes are labels or single nodes."""
    new = merged.select(F.col("node").alias("old"), F.col("label").alias("new"))
    known = labels.join(new, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    return known.unionByName(merged.join(labels.select("node"), "node", "left_anti").select("node", "label"))


def groups(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """A row for each distinct document that has near copies: doc_id, group_id (the doc_id that stays), group_size, keep."""
    found = _grouped(df, threshold, doc_id, text, block)
    same = Window.partitionBy("label").orderBy("first")
    return found.select(F.col("doc").alias("doc_id"), F.first("doc").over(same).alias("group_id"), F.col("n").alias("group_size"), (F.col("first") == 1).alias("keep"))


def drop_near_copies(df: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without those of near copies that don't stay, one row of each group."""
    key, check = fresh(df, "near_key", "near_check")
    gone = checkpoint(_grouped(df, threshold, doc_id, text).filter("first > 1").select(F.col("rid").alias(key), F.col("check").alias(check)))
    keyed = df.withColumn(key, row_key(doc_id, text)).withColumn(check, row_check(doc_id, text))
    kept = keyed.join(F.broadcast(gone) if small_enough(gone, BROADCAST_ROWS) else gone, [key, check], "left_anti")
    again = keyed.filter(F.col(text).rlike(_WORD)).groupBy(key, check).count().filter("count > 1").select(key, check)
    again = checkpoint(again)
    if not again.isEmpty():
        twice = kept.join(again, [key, check], "left_semi").dropDuplicates([key, check])
        kept = kept.join(again, [key, check], "left_anti").unionByName(twice)
    return kept.select(*[f"`{c}`" for c in df.columns])
