"""Operator 8 where the texts to score are the corpus: every document against all documents, in work that follows the input.

Same results as lm_score.lm_scores(d, d). There, each block meets each shard; here, each context meets its own copies, wherever they are:

1. Tasks cut documents into blocks of up to BLOCK_WORDS words (word codes, written once to the shared folder).
2. In a round each block asks for the corpus's counts of some of its contexts: the distinct 64-bit fingerprints of a rolling hash (of any length at once), sorted,
   cut by ranges, with the number of times that the block has each. The task of a range adds the blocks' numbers up and answers with counts in the order asked, without keys.
3. Lengths 1 and 2 are asked for all words, 3 and 4 for those whose shorter context says more than its own document: a context that occurs only as often as there are
   equal copies of the whole document is in these alone, and so are all longer ones.
4. What is left at length 4 are stretches that repeat between different documents. Their words and open positions are a state of their own, which is small. Lengths double (from
   FAR on they quadruple) until a position's count is that of its document's copies; where two lengths' counts differ, lengths between are asked: the middle one, or
   all where the two are at most WIDE apart. What a round finds is written once, beside the state; its task learns and asks for the next.
   Whether a position asks depends on true counts only, and all occurrences of a context have the same: so all of them ask, and each sum is over the whole corpus.

No length, context or document is left out. Counts are of fingerprints: of 10 ** 9 different contexts one pair shares its own with probability 0.03. Nothing of the corpus passes through the driver.
Blocks keep an executor's memory bounded; a text longer than a block is one alone.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _powers, checkpoint, mix, spread, thrifty
from .lm_score import Triple, _packed, _runs, _unpacked, log_probs

BLOCK_WORDS = 1 << 20
#: Contexts asked for, counted by one task.
RANGE_KEYS = 1 << 21
#: Shallow rounds end at this length; from FAR on, lengths quadruple.
LEVELS, FAR = 4, 64
#: Two lengths with different counts that are at most so far apart: all between are asked at once.
WIDE = 4
#: Words scored at once.
SCORE_WORDS = 1 << 17

_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD1B54A32D192ED03)
_WHOLE = 1 << 40
ANSWER = "block bigint, part int, data binary"
STATE = "block bigint, kind int, part int, open bigint, data binary"
#: Kinds of rows of a round: a block's state, its questions or the answers to them, what was found.
OPEN, ASKED, FOUND = 0, 1, 2


def _bytes(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, all first bytes first: the empty high bytes pack to nothing."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _keys(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, those below zero as odd numbers: numbers that follow one another pack to little."""
    d = np.diff(x, prepend=0)
    return np.where(d < 0, -2 * d - 1, 2 * d)


def _sums(z: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(z & 1, -(z + 1) // 2, z // 2))


class Prints:
    """Fingerprints of any run of words of codes."""

    def __init__(self, codes: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * _powers(len(codes), _BASE)[: len(codes)], dtype=np.uint64)])
        self.back = _powers(len(codes) + 1, _INVERSE)

    def __call__(self, end: np.ndarray, n: np.ndarray | int, kind: int = 0) -> np.ndarray:
        """Of the n words before end."""
        with np.errstate(over="ignore"):
            start = end - n
            return mix(mix((self.total[end] - self.total[start]) * self.back[start]) + np.asarray(n + kind).astype(np.uint64) * _STEP)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _question(block: int, keys: np.ndarray, weights: np.ndarray | None, parts: int) -> pa.RecordBatch:
    if weights is None:
        keys = np.sort(keys)
        head = _heads(keys)
        size = np.diff(np.append(head, len(keys)))
    else:
        order = np.argsort(keys)
        keys = keys[order]
        head = _heads(keys)
        size = np.add.reduceat(weights[order], head) if len(head) else head
    keys = keys[head]
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))
    used = np.flatnonzero(cuts[1:] > cuts[:-1])
    data = [_packed(_bytes(keys[cuts[k] : cuts[k + 1]]), size[cuts[k] : cuts[k + 1]]) for k in used]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(used), block)), pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], names=["block", "part", "data"])


def _told(keys: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """The counts of keys, from the answers in the order of their parts."""
    counts = np.concatenate([_unpacked(x)[0].astype(np.int64) for x in answers]) if answers else np.zeros(0, np.int64)
    order = np.argsort(keys)
    head = _heads(keys[order])
    if len(head) != len(counts):
        raise ValueError(f"{len(counts)} counts for {len(head)} contexts")
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(counts, np.diff(np.append(head, len(keys))))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    thrifty()
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for block, part, data in zip(*(b.column(c).to_pylist() for c in ("block", "part", "data")), strict=True):
            asked.setdefault(part, []).append((block, data))
    for part in list(asked):
        rows = asked.pop(part)
        keys, sizes = zip(*(_unpacked(data) for _, data in rows), strict=True)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sizes])])
        keys, sizes = np.concatenate([_keys(k) for k in keys]), np.concatenate([s.astype(np.int64) for s in sizes])
        order = np.argsort(keys)
        head = _heads(keys[order])
        sums = np.empty(len(keys), np.int64)
        sums[order] = np.repeat(np.add.reduceat(sizes[order], head), np.diff(np.append(head, len(keys))))
        data = [_packed(sums[at[k] : at[k + 1]]) for k in range(len(rows))]
        yield pa.RecordBatch.from_arrays([pa.array([block for block, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "data"])


class Shallow:
    """A block and what is known of its contexts up to LEVELS words, from the answers of the rounds so far."""

    def __init__(self, off: np.ndarray, vocabulary: np.ndarray, low: np.ndarray, high: np.ndarray, answers: list[list[bytes]]) -> None:
        self.off, self.vocabulary, self.index = off.astype(np.int64), vocabulary, (high.astype(np.int64) << 8) + low
        index = self.index
        self.row, self.inner = spread(self.off)
        self.codes = vocabulary[self.index] if len(index) else np.zeros(0, np.uint64)
        prints = Prints(self.codes)
        self.weights: np.ndarray | None = None
        self.at, self.counts = [np.arange(len(index))], []
        texts = np.flatnonzero(self.off[1:] > self.off[:-1])
        two = np.flatnonzero(self.inner > 0)
        with np.errstate(over="ignore"):
            words = mix(mix(mix(vocabulary)) + _STEP)
        self.keys = np.concatenate([prints(self.off[texts + 1], np.diff(self.off)[texts], _WHOLE), words, prints(two + 1, 2)])
        if not answers:
            self.weights = np.concatenate([np.ones(len(texts), np.int64), np.bincount(self.index, minlength=len(words)), np.ones(len(two), np.int64)])
            return
        told = _told(self.keys, answers[0])
        copies = np.zeros(len(self.off) - 1, np.int64)
        copies[texts] = told[: len(texts)]
        self.copies = copies[self.row]
        self.at.append(two)
        self.counts += [told[len(texts) : len(texts) + len(words)][self.index], told[len(texts) + len(words) :]]
        for n in range(3, LEVELS + 1):
            more = self.at[-1][(self.counts[-1] > self.copies[self.at[-1]]) & (self.inner[self.at[-1]] >= n - 1)]
            self.keys = prints(more + 1, n)
            if len(answers) <= n - 2:
                return
            self.at.append(more)
            self.counts.append(_told(self.keys, answers[n - 2]))

    def changes(self) -> Triple:
        return np.concatenate(self.at), np.concatenate([np.full(len(a), n) for n, a in enumerate(self.at, 1)]), np.concatenate(self.counts)


def _shallow(batch: pa.RecordBatch, r: int, rounds: int) -> Shallow:
    answers = [[x["data"] for x in sorted(batch.column(f"told{k}")[r].as_py() or [], key=lambda x: x["part"])] for k in range(rounds)]
    return Shallow(*_unpacked(batch.column("tokens")[r].as_py()), answers)


def _ask(rounds: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        for b in batches:
            for r in range(b.num_rows):
                s = _shallow(b, r, rounds)
                yield _question(b.column("block")[r].as_py(), s.keys, s.weights, parts)

    return run


class Deep:
    """Stretches of a block whose contexts of LEVELS words occur elsewhere: tops (longest known lengths whose count is more than the copies'), gaps between two lengths with different counts.

    Positions that share the longer of a gap's contexts share all between: they are one class, which asks once, with the number of its members, and has its changes once.
    """

    def __init__(self, fields: list[np.ndarray]) -> None:
        vocabulary, index, n_run, copies, tail, place, base, *rest = fields
        self.codes = vocabulary.astype(np.uint64)[index] if len(index) else np.zeros(0, np.uint64)
        self.n_run, self.copies, self.tail, self.place = (x.astype(np.int64) for x in (n_run, copies, tail, place))
        self.base = int(base[0])  # the next class
        rest = [x.astype(np.int64) for x in rest]
        self.gaps = [_sums(rest[0]), *rest[1:7]]  # end, length and count, longer length and count, class, members; narrow ones first
        self.tops = [np.cumsum(rest[7]), *rest[8:10]]  # end, length, count
        self.prints: Prints | None = None
        self._runs()

    @classmethod
    def begin(cls, s: Shallow) -> Deep:
        at, count = s.at[-1], s.counts[-1]
        more = count > s.copies[at]
        at, count = at[more], count[more]
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else np.zeros(0, np.int64)
        n_run = np.diff(np.append(head, len(at)))
        first = at[head]
        run, inner = spread(np.concatenate([[0], np.cumsum(n_run + LEVELS - 1)]))
        words = (first - LEVELS + 1)[run] + inner
        vocabulary, index = np.unique(s.index[words], return_inverse=True)
        e = np.flatnonzero(inner >= LEVELS - 1) + 1
        tail = np.where(s.inner[first] > LEVELS - 1, s.copies[first], 0)
        none = np.zeros(0, np.int64)
        return cls([s.vocabulary[vocabulary], index, n_run, s.copies[first], tail, first - LEVELS + 1, np.zeros(1, np.int64), *[none] * 7, np.diff(e, prepend=0), np.full(len(e), LEVELS), count])

    def _runs(self) -> None:
        self.off = np.concatenate([[0], np.cumsum(self.n_run + LEVELS - 1)]) if len(self.n_run) else np.zeros(1, np.int64)
        self.run = np.repeat(np.arange(len(self.n_run)), np.diff(self.off))

    def packed(self) -> bytes:
        vocabulary, index = np.unique(self.codes, return_inverse=True)
        (e, *gaps), (t, *tops) = self.gaps, self.tops
        return _packed(vocabulary, index, self.n_run, self.copies, self.tail, self.place, np.array([self.base]), _steps(e), *gaps, np.diff(t, prepend=0), *tops)

    def _questions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, members) of what is to be known next: of narrow gaps all lengths, of wide ones the middle, what is longer than each top. And the numbers of lengths of the narrow."""
        (g, low, _, high, _, _, size), (t, n, _) = self.gaps, self.tops
        many = (high - low - 1)[: np.count_nonzero(high - low <= WIDE)]
        k = len(many)
        end = np.cumsum(many)
        inner = np.arange(end[-1] if k else 0) + np.repeat(low[:k] + 1 - (end - many), many)
        e, n = np.concatenate([np.repeat(g[:k], many), g[k:], t]), np.concatenate([inner, (low[k:] + high[k:]) // 2, np.where(n < FAR, 2, 4) * n])
        return e, n, np.concatenate([np.repeat(size[:k], many), size[k:], np.ones(len(t), np.int64)]), many

    def _asked(self, e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the questions the corpus has to answer, their fingerprints)."""
        asked = n <= e - self.off[self.run[e - 1]]
        self.prints = self.prints or Prints(self.codes)
        return asked, self.prints(e[asked], n[asked])

    def keys(self) -> tuple[np.ndarray, np.ndarray, int]:
        """(fingerprints asked for, the number of positions for which each is, questions)."""
        e, n, weights, _ = self._questions()
        if not len(e):
            return np.zeros(0, np.uint64), weights, 0
        asked, keys = self._asked(e, n)
        return keys, weights[asked], len(e)

    def learn(self, answers: list[bytes]) -> bytes | None:
        """What was found, and the state goes on. Beyond the stretch's start only the document's copies go on, beyond the document's nothing does. What that answers waits
        for the round too: all occurrences of a context have to ask for it in the same round."""
        e, n, _, many = self._questions()
        if not len(e):
            return None
        c = self.tail[self.run[e - 1]]
        asked, keys = self._asked(e, n)
        if len(keys):
            c[asked] = _told(keys, answers)
        g, low, c_low, high, c_high, group, size = self.gaps
        t, n_top, c_top = self.tops
        k = len(e) - len(t)
        run = self.run[t - 1]
        gap = np.flatnonzero(c[k:] != c_top)
        shared = np.minimum(n[k:], t - self.off[run])[gap]
        with np.errstate(over="ignore"):
            key = self.prints(t[gap], shared)
            key = np.where(asked[k:][gap], key, mix(key + (self.tail[run][gap] + 1).astype(np.uint64) * _STEP))
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)  # classes in the order of their first positions
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, which, count = first[order], place[which], count[order]
        one, base = gap[first], self.base
        self.base += len(one)
        members = base + which, (self.place[run] + t - 1 - self.off[run])[gap]
        # Narrow gaps: the counts of all lengths between are there, so every change is.
        w = len(many)
        ends = np.cumsum(many + 1)
        inside = np.ones(int(ends[-1]) if w else 0, bool)
        inside[ends - 1] = False
        new = np.empty(len(inside), np.int64)
        new[inside], new[ends - 1] = c[: len(new) - w], c_high[:w]
        old = np.empty_like(new)
        old[1:], old[ends - many - 1] = new[:-1], c_low[:w]
        changed = np.flatnonzero(new != old)
        which = np.repeat(np.arange(w), many + 1)[changed]
        found = group[which], changed - (ends - many - 1)[which] + low[which] + 1, new[changed]
        # Wide ones fall into two.
        mid, c_mid = n[k - len(g) + w : k], c[k - len(g) + w : k]
        ways = (g[w:], g[w:], t[one]), (low[w:], mid, n_top[one]), (c_low[w:], c_mid, c_top[one]), (mid, high[w:], n[k:][one]), (c_mid, c_high[w:], c[k:][one]), (group[w:], group[w:], base + np.arange(len(one))), (size[w:], size[w:], count)
        ways = [np.concatenate(y) for y in ways]
        still, wide = ways[2] != ways[4], ways[3] - ways[1] > WIDE  # halves of what is wide have lengths between
        order = np.concatenate([np.flatnonzero(still & ~wide), np.flatnonzero(still & wide)])
        self.gaps = [y[order] for y in ways]
        more = c[k:] > self.copies[run]
        self.tops = [t[more], n[k:][more], c[k:][more]]
        self._close()
        return _packed(_steps(found[0]), *found[1:], *(_steps(y) for y in members)) if len(new) or len(gap) else None

    def _close(self) -> None:
        """Stretches without questions leave."""
        kept = np.zeros(len(self.n_run), bool)
        for x in (self.gaps, self.tops):
            kept[self.run[x[0] - 1]] = True
        if kept.all():
            return
        gone = np.cumsum(np.where(kept, 0, np.diff(self.off)))
        for x in (self.gaps, self.tops):
            x[0] = x[0] - gone[self.run[x[0] - 1]]
        self.codes, self.prints = self.codes[kept[self.run]], None
        self.n_run, self.copies, self.tail, self.place = self.n_run[kept], self.copies[kept], self.tail[kept], self.place[kept]
        self._runs()


class Found:
    """What all rounds have found of a block's longer contexts."""

    def __init__(self, rows: list[bytes]) -> None:
        fields = [_unpacked(x) for x in rows]
        group, self.n, self.count, member, position = (np.concatenate([_sums(x[i].astype(np.int64)) if i in (0, 3, 4) else x[i].astype(np.int64) for x in fields]) for i in range(5))
        order = np.argsort(group)
        self.n, self.count = self.n[order], self.count[order]
        self.head = np.searchsorted(group[order], np.arange(int(max(group.max(initial=-1), member.max(initial=-1))) + 2))  # of each class
        order = np.argsort(position)
        self.member, self.position = member[order], position[order]

    def changes(self, first: int, last: int) -> Triple:
        """Of the positions from first to before last."""
        x = slice(*np.searchsorted(self.position, [first, last]))
        mine, position = self.member[x], self.position[x]
        head = self.head[mine]
        which, inner = spread(np.concatenate([[0], np.cumsum(self.head[mine + 1] - head)]))
        at = head[which] + inner
        return position[which], self.n[at], self.count[at]


def _row(block: int, kind: int, asked: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([0], pa.int32()), pa.array([asked], pa.int64()), pa.array([data], pa.binary())], names=["block", "kind", "part", "open", "data"])


def _going_on(block: int, deep: Deep, parts: int) -> Iterator[pa.RecordBatch]:
    """A block's state and its questions of the next round; nothing if it has none."""
    keys, weights, asked = deep.keys()
    if asked:
        yield _row(block, OPEN, asked, deep.packed())
    if len(keys):
        q = _question(block, keys, weights, parts)
        yield pa.RecordBatch.from_arrays([q.column("block"), pa.array(np.full(q.num_rows, ASKED, np.int32)), q.column("part"), pa.array(np.zeros(q.num_rows, np.int64)), q.column("data")], names=["block", "kind", "part", "open", "data"])


def _begin(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        for b in batches:
            for r in range(b.num_rows):
                s = _shallow(b, r, LEVELS - 1)
                if len(s.index):
                    deep = Deep.begin(s)
                    del s
                    yield from _going_on(b.column("block")[r].as_py(), deep, parts)

    return run


def _learn(parts: int):
    """Rows sorted by block, kind and part: a block's state and the answers to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        now, state, answers = None, b"", []

        def rows() -> Iterator[pa.RecordBatch]:
            deep = Deep(_unpacked(state))
            found = deep.learn(answers)
            if found is not None:
                yield _row(now, FOUND, 0, found)
            yield from _going_on(now, deep, parts)

        for b in batches:
            for r, kind in enumerate(b.column("kind").to_pylist()):
                if kind == ASKED:
                    answers.append(b.column("data")[r].as_py())
                else:
                    if now is not None:
                        yield from rows()
                    now, state, answers = b.column("block")[r].as_py(), b.column("data")[r].as_py(), []
        if now is not None:
            yield from rows()

    return run


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (off, codes, ids) in enumerate(_runs(batches, limit)):
            vocabulary, index, many = np.unique(codes, return_inverse=True, return_counts=True)
            order = np.argsort(-many)  # frequent words get small numbers: with the low bytes apart they pack to less
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            index = rank[index]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), lists, pa.array([_packed(off, vocabulary[order], index & 255, index >> 8)], pa.binary()), pa.array([len(codes)], pa.int64())], names=["block", "ids", "tokens", "words"])

    return run


def _merged(known: Triple, deep: Found | None, first: int, last: int) -> Triple:
    """All changes of the positions from first to before last, positions counted from first."""
    p, n, c = (np.concatenate(x) for x in zip(known, deep.changes(first, last), strict=True)) if deep is not None else known
    order = np.argsort(p * (1 << 32) + n)  # what has the same place has the same count
    p, n, c = p[order] - first, n[order], c[order]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (c[1:] != c[:-1])]) if len(p) else np.zeros(0, bool)
    return p[new], n[new], c[new]


def _score(names: list[str], total: int, gamma: float, vocabulary: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thrifty()
        for b in batches:
            for r in range(b.num_rows):
                s, found = _shallow(b, r, LEVELS - 1), b.column("deep")[r].as_py()
                p, n, c = s.changes() if len(s.index) else (np.zeros(0, np.int64),) * 3
                deep = Found(found) if found else None
                order = np.argsort(p)
                p, n, c = p[order], n[order], c[order]
                ids, off, start = b.column("ids").slice(r, 1).flatten(), s.off, 0
                del s
                while start < len(off) - 1:
                    end = max(start + 1, int(np.searchsorted(off, off[start] + SCORE_WORDS, side="right")) - 1)
                    x, own = slice(*np.searchsorted(p, off[[start, end]])), off[start : end + 1] - off[start]
                    match, context, following, probs = log_probs(own, *_merged((p[x], n[x], c[x]), deep, off[start], off[end]), total, gamma, vocabulary)
                    sums = np.concatenate([[0.0], np.cumsum(probs)])
                    lists = [pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(v)) for v in (match.astype(np.int32), context, following, probs)]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), pa.array(np.diff(own).astype(np.int32)), pa.array(sums[own[1:]] - sums[own[:-1]]), *lists], names=names)
                    start = end

    return run


def _release(spark: SparkSession) -> None:
    """Checkpoints of rounds that are over go when the driver collects its garbage, which it would seldom do by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _drop(df: DataFrame) -> None:
    """Delete the files of a checkpoint that is not read any more."""
    sc, file = df.sparkSession.sparkContext, df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files go as soon as what was planned has been written to a checkpoint (garbage collection leaves those of a round or two), and checkpoints know how they are partitioned.
_ROUNDS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.enabled": "false"}


@contextmanager
def _rounds(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _ROUNDS}
    try:
        for k, v in _ROUNDS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def self_scores(df: DataFrame, schema: T.StructType, gamma: float, vocabulary: float, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per row of df, scored against all of df."""
    spark = df.sparkSession
    asked = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(schema["doc_id"].dataType)), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.LongType())])
    with _rounds(spark):
        width = -(-int(asked.agg(F.sum(F.length("text"))).head()[0] or 0) // (6 * block_words)) + 1  # a block or less
        blocks = checkpoint(asked.mapInArrow(_blocks(block_words), kind).repartition(width, "block"))  # checkpoints keep their partitioning: joins by block don't move the words again
        total = blocks.agg(F.coalesce(F.sum("words"), F.lit(0))).head()[0]
        _release(spark)
        known, parts = blocks, max(1, -(-total // RANGE_KEYS))
        for k in range(LEVELS - 1):
            told = known.mapInArrow(_ask(k, parts), ANSWER).repartitionById(parts, "part").mapInArrow(_count, ANSWER)
            told = checkpoint(told.repartition(width, "block").groupBy("block").agg(F.collect_list(F.struct("part", "data")).alias(f"told{k}")))  # a row a block, smaller than it
            known = known.join(told, "block", "left")
            _release(spark)
        state, found = checkpoint(known.mapInArrow(_begin(parts), STATE)), []
        while open_ := state.agg(F.sum("open")).head()[0]:
            told = state.filter(F.col("kind") == ASKED).select("block", "part", "data").repartitionById(parts, "part").mapInArrow(_count, ANSWER)
            told = checkpoint(told)
            both = state.filter(F.col("kind") == OPEN).unionByName(told.select("block", F.lit(ASKED).alias("kind"), "part", F.lit(0).cast("bigint").alias("open"), "data"))
            parts = max(1, -(-open_ // RANGE_KEYS))  # for what is asked next
            last, state = state, checkpoint(both.repartition(width, "block").sortWithinPartitions("block", "kind", "part").mapInArrow(_learn(parts), STATE))
            found.append(checkpoint(state.filter(F.col("kind") == FOUND).select("block", "data").coalesce(-(-width // 8))))
            _drop(last)
            _drop(told)
            del told, both, last
            _release(spark)
    found = functools.reduce(DataFrame.unionByName, found, spark.createDataFrame([], "block bigint, data binary"))
    found = found.repartition(width, "block").groupBy("block").agg(F.collect_list("data").alias("deep"))
    return known.join(found, "block", "left").drop("words").mapInArrow(_score(schema.names, total, gamma, vocabulary), schema)
