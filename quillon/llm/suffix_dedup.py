"""Operator 4: repeated passages by suffix arrays.

A passage of at least MIN_WORDS (50) words that occurs twice anywhere in the corpus is found, whole texts, exactly by words
(runs of non-white-space, compared by 32-bit codes where two passages already share 25 words by 64-bit fingerprint).

1. Anchors. Of each 26 successive runs of 25 words, the one with the least fingerprint is an anchor (one in 13 or so). A
   50-word window holds 26 such runs, so equal windows hold equal anchors, wherever they stand.
2. Anchors whose fingerprint occurs once in the corpus are dropped (counted with partial sums, so that a hot one is no group in a task). The others bring the words of
   the 50-word windows whose least run they are to the partition of their fingerprint, sorted by it. A window has one such anchor, the same wherever it stands.
   So it is these minimisers that bring passages of all shards together: suffix arrays of the whole corpus would have to meet pair by pair.
3. There each shard of up to SHARD_WORDS words gets its suffix array (Larsson-Sadakane) and common prefixes (Kasai): windows whose
   common prefix is 50 or more are equal. Where a fingerprint's occurrences go over a shard's end, the next shard's windows are
   merged with those before by binary search in their sorted fingerprints.
4. Fingerprints with more than HOT occurrences (a licence, a footer) aren't brought to one partition: their windows are hashed and counted with partial sums
   (64 bits of the window and 64 of the anchor), and each occurrence meets its window's first place in a join that splits hot keys.
5. Windows are merged into spans per document. cut_passages() gives the texts without the spans to cut.

Shuffled: a row of 20 bytes an anchor, once or, if the repeated ones are too many to be sent, twice; 300 bytes of words a repeated anchor, and texts once, if
the documents with repeats are too many to be sent as a list of ids.

Results: one row per span: doc_id (of any type that sorts), start_word and end_word (of the words split at white space, end excluded), keep: true for
the occurrence that comes first (by doc_id, nulls first), false for those to cut. Null, empty and shorter texts have none. Rows equal in id and text are one
document. Of equal texts with different ids each is a document; a passage repeated within one document counts too. Extra columns don't matter; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, row_key, slices, small_enough, spread, window_prints, word_codes
from .suffix import kasai, suffix_array

MIN_WORDS = 50
SHARD_WORDS = 1 << 19
#: Documents with repeats up to this number (8 bytes of key each, and their anchors) are sent to every executor instead of shuffling texts.
BROADCAST_ROWS = 100_000
#: Fingerprints up to this number (16 bytes each) are sent to every executor instead of shuffling anchors again.
BROADCAST_PRINTS = 1_000_000
#: Occurrences of a fingerprint (some 300 bytes each) that go to one task.
HOT = 200_000


def _least(codes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the least run's fingerprint, the leftmost of equal ones, for each window of min_words codes; all runs' fingerprints). Places ascend."""
    run = min_words // 2
    prints = window_prints(codes, run)
    wide = min_words - run + 1
    n = len(prints) - wide + 1
    if n < 1:
        return np.zeros(0, np.int64), prints
    least = np.arange(len(prints))
    have = 1
    while have < wide:  # by doubling
        step = min(have, wide - have)
        a, b = least[: len(least) - step], least[step:]
        least = np.where(prints[a] <= prints[b], a, b)
        have += step
    return least[:n], prints


def anchors(off: np.ndarray, codes: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(place in codes, fingerprint) of each anchor."""
    least, prints = _least(codes, min_words)
    n_words = np.diff(off)
    inside = np.zeros(len(least), bool)
    for s, k in zip(off[:-1][n_words >= min_words].tolist(), n_words[n_words >= min_words].tolist(), strict=True):
        inside[s : s + k - min_words + 1] = True
    at = np.unique(least[inside])
    return at, prints[at]


def _find_anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            off, codes = word_codes(part.column(1))
            at, prints = anchors(off, codes, min_words)
            row = np.searchsorted(off, at, side="right") - 1
            rid = part.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(rid[row]), pa.array((at - off[row]).astype(np.int32))], names=["fp", "rid", "pos"])

    return run


def _cut_contexts(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            off, codes = word_codes(part.column("text"))
            lists = part.column("hits")
            hit_off = lists.offsets.to_numpy().astype(np.int64)
            hit = lists.flatten().field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
            fp, hot = lists.flatten().field("fp"), lists.flatten().field("hot")
            row, _ = spread(hit_off - hit_off[0])
            least, _ = _least(codes, min_words)
            place = off[:-1][row] + hit
            start = np.maximum(np.searchsorted(least, place, side="left"), off[:-1][row]) - off[:-1][row]
            end = np.minimum(np.searchsorted(least, place, side="right") - 1, off[1:][row] - min_words) - off[:-1][row] + min_words
            bounds = np.concatenate([[0], np.cumsum(end - start)])
            place = np.arange(bounds[-1]) + np.repeat(off[:-1][row] + start - bounds[:-1], end - start)
            words = (codes[place] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ctx = pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(words)])
            yield pa.RecordBatch.from_arrays([fp, hot, part.column("rid").take(pa.array(row)), part.column("doc").take(pa.array(row)), pa.array(start.astype(np.int32)), ctx], names=["fp", "hot", "rid", "doc", "start", "ctx"])

    return run


def _windows(min_words: int):
    """(fp, window, rid, doc, pos) of each window of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ctx"):
            off, words = _words_of(part.column("ctx"))
            prints = window_prints(words.astype(np.uint64), min_words)
            n = np.diff(off) - min_words + 1
            row, inner = spread(np.concatenate([[0], np.cumsum(n)]))
            rows = pa.array(row)
            pos = part.column("start").to_numpy()[row] + inner
            yield pa.RecordBatch.from_arrays([part.column("fp").take(rows), pa.array(prints[off[:-1][row] + inner].view(np.int64)), part.column("rid").take(rows), part.column("doc").take(rows), pa.array(pos.astype(np.int32))], names=["fp", "window", "rid", "doc", "pos"])

    return run


def _words_of(ctx: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, words) of contexts."""
    raw = np.frombuffer(ctx.buffers()[1], np.int32, len(ctx) + 1, ctx.offset * 4).astype(np.int64)
    words = np.frombuffer(ctx.buffers()[2], np.uint8)[raw[0] : raw[-1]].view(np.uint32) if raw[-1] > raw[0] else np.zeros(0, np.uint32)
    return (raw - raw[0]) // 4, words


class _Open:
    """Windows seen so far of the fingerprint that goes over a shard's end: sorted prints, and those that occurred once."""

    def __init__(self) -> None:
        self.fp: int | None = None
        self.known = np.zeros(0, np.uint64)
        self.single: dict[int, tuple[int, object, int]] = {}


def _repeats(fp: np.ndarray, rid: np.ndarray, doc: pa.Array, start: np.ndarray, off: np.ndarray, words: np.ndarray, min_words: int, open_: _Open, last_goes_on: bool) -> tuple[list[tuple], list[tuple]]:
    """((row, start, end, keep) of the repeated windows of one shard, merged where they touch within a context; (rid, doc, start, end, keep) of windows of shards before). Rows are sorted by fp, then by document."""
    n = len(fp)
    length = np.diff(off)
    # Suffixes end at their context: a code of its own stands after each.
    _, dense = np.unique(words, return_inverse=True)
    text = np.empty(len(words) + n, np.int64)
    row, inner = spread(off)
    text[off[:-1][row] + row + inner] = dense
    text[off[1:] + np.arange(n)] = len(words) + 1 + np.arange(n)
    sa, rank = suffix_array(text)
    common = kasai(text, sa, rank)
    t_off = off + np.arange(n + 1)
    owner = np.repeat(np.arange(n), length + 1)
    remaining = t_off[1:][owner] - 1 - np.arange(len(text))
    usable = remaining[sa] >= min_words
    # Places of the array with a common prefix of min_words or more belong together; a window's place is one of them.
    group = np.cumsum(common < min_words)[usable]
    at = sa[usable]
    if not len(at):
        return [], []
    doc_rank = np.cumsum(np.concatenate([[False], (fp[1:] != fp[:-1]) | (rid[1:] != rid[:-1])])).astype(np.int64)  # equal windows have one fp, within which rows are in the documents' order
    who = owner[at]
    pos = start[who].astype(np.int64) + (at - t_off[:-1][who])
    key = (doc_rank[who] << 31) | pos
    first = np.concatenate([[True], group[1:] != group[:-1]])
    heads = np.flatnonzero(first)
    least, most = np.minimum.reduceat(key, heads), np.maximum.reduceat(key, heads)
    g = np.cumsum(first) - 1
    repeated, keep = (least != most)[g], (key == least[g])
    before: list[tuple] = []
    border = (fp[who] == open_.fp) if open_.fp is not None else np.zeros(len(at), bool)
    going = fp[who] == fp[-1] if last_goes_on else np.zeros(len(at), bool)
    if border.any() or going.any():
        # The shard's windows by print, to be merged with those of the shards before by binary search.
        plain = np.zeros(len(text), np.uint64)
        plain[off[:-1][row] + row + inner] = words
        prints = window_prints(plain, min_words)[at]
        if border.any():
            place = np.searchsorted(open_.known, prints)
            seen = border & (place < len(open_.known)) & (open_.known[np.minimum(place, max(len(open_.known) - 1, 0))] == prints) if len(open_.known) else np.zeros(len(at), bool)
            for p in np.unique(prints[seen]).tolist():
                one = open_.single.get(p)
                mine = seen & (prints == np.uint64(p)) if one is not None else None
                if one is not None and any((int(rid[w]), int(x)) != (one[0], one[2]) for w, x in zip(who[mine], pos[mine], strict=True)):
                    before.append((one[0], one[1], one[2], one[2] + min_words, True))
                    del open_.single[p]
            alone = np.array([int(p) in open_.single for p in prints[seen]], bool)
            back = np.flatnonzero(seen)[~alone]
            repeated[back], keep[back] = True, False
        if going.any():
            if open_.fp != int(fp[-1]):
                open_.fp, open_.known, open_.single = int(fp[-1]), np.zeros(0, np.uint64), {}
            old = set(open_.single)
            fresh_ = going & ~np.isin(prints, open_.known)
            for k in np.flatnonzero(fresh_ & ~repeated).tolist():
                if int(prints[k]) not in old:
                    open_.single[int(prints[k])] = (int(rid[who[k]]), doc[int(who[k])].as_py(), int(pos[k]))
            more = np.unique(prints[fresh_])
            open_.known = np.insert(open_.known, np.searchsorted(open_.known, more), more)
    if not last_goes_on:
        open_.fp, open_.known, open_.single = None, np.zeros(0, np.uint64), {}
    chosen = np.flatnonzero(repeated)
    order = chosen[np.lexsort((pos[chosen], keep[chosen], who[chosen]))]
    if not len(order):
        return [], before
    w, p, k = who[order], pos[order], keep[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (k[1:] != k[:-1]) | (p[1:] > p[:-1] + min_words)])
    s = np.flatnonzero(new)
    e = np.concatenate([s[1:], [len(order)]]) - 1
    return [(w[s], p[s], p[e] + min_words, k[s])], before


def _find_repeats(min_words: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _Open()
        held: list[pa.RecordBatch] = []
        size = 0
        names = ["rid", "doc", "start", "end", "keep"]

        def work(parts: list[pa.RecordBatch], following: int | None) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            fp, rid, doc = table.column("fp").to_numpy(), table.column("rid").to_numpy(), table.column("doc")
            found, before = _repeats(fp, rid, doc, table.column("start").to_numpy(), *_words_of(table.column("ctx")), min_words, open_, following is not None and following == int(fp[-1]))
            for w, start, end, keep in found:
                yield pa.RecordBatch.from_arrays([pa.array(rid[w]), doc.take(pa.array(w)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(keep)], names=names)
            if before:
                r, d, start, end, keep = zip(*before, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(d, doc.type), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(keep, pa.bool_())], names=names)

        for batch in batches:
            for part in slices(iter([batch]), "ctx", shard_words * 2):
                if held and size >= shard_words:
                    yield from work(held, part.column(0)[0].as_py())
                    held, size = [], 0
                held.append(part)
                size += part.column("ctx").nbytes // 4
        if held:
            yield from work(held, None)

    return run


def _hot_windows(contexts: DataFrame, min_words: int, kind: T.DataType) -> DataFrame:
    """The same as _find_repeats for contexts of hot fingerprints."""
    fields = [("fp", T.LongType()), ("window", T.LongType()), ("rid", T.LongType()), ("doc", kind), ("pos", T.IntegerType())]
    windows = checkpoint(contexts.mapInArrow(_windows(min_words), T.StructType([T.StructField(n, k) for n, k in fields])))
    place = F.struct(F.col("doc").isNotNull().alias("has"), "doc", "rid", "pos")
    firsts = windows.groupBy("fp", "window").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most").select("fp", "window", "least")
    met = windows.join(firsts, ["fp", "window"])
    return met.select("rid", "doc", F.col("pos").alias("start"), (F.col("pos") + min_words).alias("end"), (place == F.col("least")).alias("keep"))


def _spans(df: DataFrame, min_words: int, shard_words: int, doc_id: str, text: str, hot: int) -> DataFrame:
    """(rid, doc, start, end, keep) of each span."""
    kind = df.schema[doc_id].dataType
    docs = df.select(row_key(doc_id, text).alias("rid"), F.col(text).alias("text"), F.col(doc_id).alias("doc")).filter(F.col("text").isNotNull())
    found = checkpoint(docs.select("rid", "text").mapInArrow(_find_anchors(min_words), "fp bigint, rid bigint, pos int"))
    places = [f(c).alias(f"{n}_{c}") for c in ("rid", "pos") for n, f in (("min", F.min), ("max", F.max))]
    repeated = checkpoint(found.groupBy("fp").agg(*places, F.count(F.lit(1)).alias("n")).filter("min_rid < max_rid or min_pos < max_pos").select("fp", (F.col("n") > hot).alias("hot")))
    few = small_enough(repeated, BROADCAST_PRINTS)
    hits = checkpoint(found.join(F.broadcast(repeated) if few else repeated, "fp").groupBy("rid").agg(F.collect_set(F.struct("pos", "fp", "hot")).alias("hits")))
    if small_enough(hits, BROADCAST_ROWS):
        only = docs.join(F.broadcast(hits.select("rid")), "rid", "left_semi").join(hits, "rid")
    else:
        only = docs.join(hits, "rid")
    fields = [("fp", T.LongType()), ("hot", T.BooleanType()), ("rid", T.LongType()), ("doc", kind), ("start", T.IntegerType()), ("ctx", T.BinaryType())]
    contexts = only.select("rid", "text", "doc", "hits").mapInArrow(_cut_contexts(min_words), T.StructType([T.StructField(n, k) for n, k in fields]))
    any_hot = not repeated.filter("hot").isEmpty()
    if any_hot:
        contexts = checkpoint(contexts)
    spans = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc", kind), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("keep", T.BooleanType())])
    windows = contexts.filter("not hot").drop("hot").repartition("fp").sortWithinPartitions("fp", "doc", "rid", "start").mapInArrow(_find_repeats(min_words, shard_words), spans)
    if any_hot:
        windows = windows.unionByName(_hot_windows(contexts.filter("hot").drop("hot"), min_words, kind))
    windows = windows.distinct()
    order = Window.partitionBy("rid", "keep").orderBy("start", "end")
    islands = windows.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("island", F.sum((F.coalesce("reach", F.lit(-1)) < F.col("start")).cast("int")).over(order))
    return islands.groupBy("rid", "keep", "island").agg(F.first("doc").alias("doc"), F.min("start").alias("start"), F.max("end").alias("end")).select("rid", "doc", "start", "end", "keep")


def repeated_passages(df: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    return _spans(df, min_words, shard_words, doc_id, text, hot).select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), "keep")


def cut_passages(df: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """df with the repeated passages cut from its texts, but for the occurrence of each that is kept. All rows and columns stay; a text that is all repeated is ''; repeated rows are cut alike."""
    key, cuts = fresh(df, "passage_key", "passage_cuts")
    spans = _spans(df, min_words, shard_words, doc_id, text, hot)
    # Words of the occurrence that is kept stay, even where a passage to cut overlaps it.
    gone = spans.groupBy(F.col("rid").alias(key)).agg(F.collect_list(F.struct("keep", "start", "end")).alias(cuts)).filter(F.exists(cuts, lambda x: ~x["keep"]))
    gone = checkpoint(gone)
    joined = df.withColumn(key, row_key(doc_id, text)).join(F.broadcast(gone) if small_enough(gone, BROADCAST_ROWS) else gone, key, "left").drop(key)
    names = df.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            texts = b.column(at).to_pylist()
            for k, found in enumerate(b.column(len(names)).to_pylist()):
                if found is not None and texts[k] is not None:
                    texts[k] = cut_words(texts[k], [(x["start"], x["end"]) for x in found if not x["keep"]], [(x["start"], x["end"]) for x in found if x["keep"]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.column(k).type) if k == at else b.column(k) for k in range(len(names))], names=names)

    return joined.mapInArrow(run, df.schema)


def cut_words(text: str, spans: list[tuple[int, int]], keep: list[tuple[int, int]] = ()) -> str:
    """The text without the words of spans, but for those of keep; white space after a word goes with it."""
    at = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
    gone = np.zeros(len(at) - 1, bool)
    for start, end in spans:
        gone[start:end] = True
    for start, end in keep:
        gone[start:end] = False
    return text[: at[0]] + "".join(text[at[k] : at[k + 1]] for k in np.flatnonzero(~gone).tolist())
