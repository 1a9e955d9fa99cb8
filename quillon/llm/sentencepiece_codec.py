"""Operator 1: SentencePiece encoding and decoding (merge-type models) by a prefix table.

A merge-type (BPE) encoding has two properties that make a linear scan enough. Each prefix of a text has one last token,
whatever follows; and a sequence of tokens is an encoding exactly if each adjacent pair is. So the table of last tokens
is filled from left to right: among the vocabulary entries that end at a position (found by an automaton over reversed
entries), the one that is compatible with the last token of the prefix before it is the last token here. Ids are then
recovered backwards from the end.

No entry has a word-start mark after another character, so merges never cross such a place and a text is encoded as its
words, each distinct word of a batch once, all words in step, in numpy.

Results: ids are those of the public library on the same model (tests hold them against it). Null text: null ids, null
decoded text and null count. Empty text: no ids, ''. A text that holds U+2581 decodes with a space in its place, as
in the library. Characters outside the vocabulary become byte entries. Rows are independent, so ties, repeated rows and
extra columns (kept as they are; a clashing name gets leading underscores) change nothing; an empty table gives an
empty table.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, offsets_of, ragged_take, slices

MODEL = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
#: Characters from which a word is cut where no entry could span.
LONG = 40
_NONE = -1
#: Bytes of text encoded at once: the tables of a slice are some thirty times as large.
SLICE = 2 << 20


class _Table:
    """Open-addressing map from non-negative int64 keys to int32, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, _NONE, np.int32)
        self.most = 0
        left = np.arange(len(keys))
        slot = self._slot(keys)
        step = 0
        while len(left):
            free = self.key[slot] == -1
            self.key[slot[free]] = keys[left[free]]  # of several for one slot, one stays
            won = self.key[slot] == keys[left]
            self.value[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
            step += 1
        self.most = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.value[slot], _NONE).astype(np.int32)
        left = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[left]
        for _ in range(self.most):
            if not len(left):
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.key[slot]
            hit = found == keys[left]
            out[left[hit]] = self.value[slot[hit]]
            go = ~hit & (found != -1)
            left, slot = left[go], slot[go]
        return out


class PieceCodec:
    """Encoder and decoder of one merge-type model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size = n
        byte = [model.is_byte(i) for i in range(n)]
        plain = [not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        piece = [model.id_to_piece(i) for i in range(n)]
        score = [model.get_score(i) for i in range(n)]
        for i in range(n):
            if plain[i] and MARK in piece[i].lstrip(MARK):
                raise ValueError(f"entry {i} has a word start inside a word: this model's words aren't independent")
        self.byte_id = np.full(256, model.unk_id(), np.int32)
        raw: list[bytes] = []
        for i in range(n):
            if byte[i]:
                self.byte_id[int(piece[i][3:5], 16)] = i
                raw.append(bytes([int(piece[i][3:5], 16)]))
            elif plain[i]:
                raw.append(piece[i].replace(MARK, " ").encode())
            else:
                raw.append(" ⁇ ".encode() if model.is_unknown(i) else b"")
        #: Bytes of each entry, and after them those of each entry that begins a text: without the space of the first mark.
        self.raw = pa.array(raw + [x[x[:1] == b" " :] for x in raw], pa.binary())
        ids = {piece[i]: i for i in range(n) if plain[i]}
        #: Order of merging: single characters first, then by score from the highest, ties by id.
        multi = sorted((i for i in ids.values() if len(piece[i]) > 1), key=lambda i: (-score[i], i))
        rank = np.full(n + 1, -1, np.int64)
        last = None
        for k, i in enumerate(multi):
            rank[i] = rank[last] if last is not None and score[last] == score[i] else k
            last = i
        self.rank = rank
        order = rank.tolist()
        pair: dict[tuple[int, int], int] = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pair[a, b] = i
        self.left = np.arange(n + 1, dtype=np.int32)
        self.right = np.arange(n + 1, dtype=np.int32)
        usable = []
        for p, i in ids.items():
            if len(p) == 1:
                usable.append(i)
                continue
            now = [ids.get(c, n) for c in p]
            while len(now) > 1:
                best, at = None, -1
                for k in range(len(now) - 1):
                    m = pair.get((now[k], now[k + 1]))
                    if m is not None and (best is None or order[m] < order[best]):
                        best, at = m, k
                if best is None:
                    break
                if len(now) == 2:
                    self.left[i], self.right[i] = now
                now[at : at + 2] = [best]
            if now == [i]:  # entries that merging never makes are no candidates
                usable.append(i)
        self.pairs = _Table(np.array([a * (n + 1) + b for a, b in pair], np.int64), np.array(list(pair.values()), np.int32))
        chars = sorted({c for i in usable for c in piece[i]})
        self.cls = np.zeros(0x110000, np.int32)  # 0: in no entry
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.wide = len(chars) + 1
        edges: dict[int, int] = {}
        token = [_NONE]
        for i in usable:  # automaton over the entries read backwards
            at = 0
            for c in reversed(piece[i]):
                key = at * self.wide + int(self.cls[ord(c)])
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token)
                    token.append(_NONE)
                at = nxt
            token[at] = i
        self.edges = _Table(np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)))
        self.token = np.array(token, np.int32)
        self.longest = max(len(piece[i]) for i in usable)
        inside = sorted({int(self.cls[ord(x)]) * self.wide + int(self.cls[ord(y)]) for i in usable for x, y in zip(piece[i], piece[i][1:])})
        self.inside = _Table(np.array(inside, np.int64), np.zeros(len(inside), np.int32))
        self.seen_key = np.full(1 << 20, -1, np.int64)
        self.seen = np.zeros(1 << 20, bool)

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the token pairs (a, b) as they are. Size stands for a character of no entry."""
        key = a.astype(np.int64) * (self.size + 1) + b
        with np.errstate(over="ignore"):
            slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        known = self.seen_key[slot] == key
        out = self.seen[slot]
        new = np.flatnonzero(~known)
        if len(new):
            unique, back = np.unique(key[new], return_inverse=True)
            fine = self._test(unique // (self.size + 1), unique % (self.size + 1))
            out[new] = fine[back]
            self.seen_key[slot[new]] = key[new]
            # of keys that share a slot the last stays in both arrays: numpy assigns in order
            self.seen[slot[new]] = out[new]
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Go back through the merges of both sides, latest first; the pair fails if one across the border came sooner."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            across = self.pairs.get(a * (self.size + 1) + b)
            bad = (across != _NONE) & (self.rank[across] < limit)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            back_a = ra > rb
            done = (ra < 0) & (rb < 0)
            # The left token was made before an equal merge across the border; the right one after it.
            limit = np.where(back_a, ra, rb + 1)
            a, b = np.where(back_a, self.right[a], a), np.where(back_a, b, self.left[b])
            go = ~(bad | done)
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of strings that each are a word with its marks, encoded on its own."""
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        word_off = off = np.concatenate([[0], np.cumsum(lengths)])
        cls = self.cls[text]
        if len(lengths) and lengths.max() > LONG:  # cut long words where no entry spans two characters
            cut = np.zeros(len(text) + 1, bool)
            cut[off] = True
            at = np.flatnonzero(np.repeat(lengths > LONG, lengths)[1:])
            cut[at[self.inside.get(cls[at].astype(np.int64) * self.wide + cls[at + 1]) == _NONE] + 1] = True
            off = np.flatnonzero(cut)
            lengths = np.diff(off)
        order = np.argsort(-lengths, kind="stable")  # so that the words still running are a prefix
        start = off[:-1][order]
        length = lengths[order]
        last = np.full(len(text), self.size, np.int32)  # each prefix's last token
        width = np.ones(len(text), np.int8)
        most = int(length[0]) if len(length) else 0
        running = np.searchsorted(-length, -np.arange(most + 1), side="right")  # words longer than k - 1
        for end in range(1, most + 1):
            at = start[: running[end]] + end - 1
            found = np.full((min(end, self.longest), len(at)), _NONE, np.int32)
            live, state = np.arange(len(at)), np.zeros(len(at), np.int64)
            for k in range(len(found)):  # automaton: the entries that end here, by length
                nxt = self.edges.get(state * self.wide + cls[at[live] - k])
                go = nxt != _NONE
                live, state = live[go], nxt[go].astype(np.int64)
                if not len(live):
                    break
                found[k, live] = self.token[state]
            left = np.arange(len(at))
            for k in range(len(found) - 1, -1, -1):
                token = found[k, left]
                some = np.flatnonzero(token != _NONE)
                if not len(some):
                    continue
                if end == k + 1:
                    fine = some
                else:
                    fine = some[self._compatible(last[at[left[some]] - k - 1], token[some])]
                last[at[left[fine]]], width[at[left[fine]]] = token[fine], k + 1
                rest = np.ones(len(left), bool)
                rest[fine] = False
                left = left[rest]
                if not len(left):
                    break
            # where none fits, the character is in no entry: last stays size, width 1
        at, out_at, out_id = off[1:] - 1, [], []
        live = np.flatnonzero(lengths > 0)
        pos = at[live]
        while len(live):  # ids backwards, all words in step
            out_at.append(pos)
            out_id.append(last[pos])
            pos = pos - width[pos]
            go = pos >= off[:-1][live]
            live, pos = live[go], pos[go]
        where = np.zeros(len(text), bool)
        chosen = np.zeros(len(text), np.int32)
        for p, i in zip(out_at, out_id, strict=True):
            where[p] = True
            chosen[p] = i
        ends = np.flatnonzero(where)
        ids = chosen[ends]
        out = np.concatenate([[0], np.cumsum(where)])[word_off]
        unknown = np.flatnonzero(ids == self.size)
        if len(unknown):  # bytes for characters of no entry
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in text[ends[unknown]]]
            n = np.ones(len(ids), np.int64)
            n[unknown] = [len(x) for x in raw]
            place = np.concatenate([[0], np.cumsum(n)])
            wide = np.repeat(ids, n)
            at = np.concatenate([np.arange(place[u], place[u + 1]) for u in unknown])
            wide[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            out, ids = place[out], wide
        return out, ids

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text; null for null."""
        # A mark in the text is a space to the model. Words are cut before each run of spaces.
        plain = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        lists = pc.split_pattern(plain, " ")
        off = offsets_of(lists)
        flat = lists.flatten()
        empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # runs of spaces belong to the word after them
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            tail = np.zeros(len(flat), bool)
            tail[off[1:] - 1] = True
            keep = ~empty | tail
            at = np.flatnonzero(keep)
            before = np.concatenate([[-1], at[:-1]])
            marks = at - np.maximum(before, off[row[at]] - 1)
            longer = np.flatnonzero(marks > 1)
            words = flat.take(pa.array(at))
            index, distinct = _coded(words)
            names = [MARK + w for w in distinct]
            if len(longer):
                extra: dict[tuple[int, int], int] = {}
                index = index.copy()
                for j, m, w in zip(longer.tolist(), marks[longer].tolist(), index[longer].tolist(), strict=True):
                    k = extra.get((m, w))
                    if k is None:
                        k = extra[m, w] = len(names)
                        names.append(MARK * m + distinct[w])
                    index[j] = k
            off = np.searchsorted(at, off)
            blank = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
        else:
            index, distinct = _coded(flat)
            names = [MARK + w for w in distinct]
            blank = np.zeros(len(texts), bool)
        word_off, word_ids = self.encode_words(pa.array(names, pa.large_string()))
        if blank.any():  # the empty text has no ids, not even the leading mark's
            names.append("")
            word_off = np.concatenate([word_off, word_off[-1:]])
            index = index.copy()
            index[off[:-1][blank]] = len(names) - 1
        counted, ids = ragged_take(word_off, word_ids, index)
        mask = pa.array(~texts.is_valid().to_numpy(zero_copy_only=False)) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(counted[off].astype(np.int32)), pa.array(ids), mask=mask)

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text for each list of ids; null for null, and for a list with a null or an id outside the model."""
        off, flat = offsets_of(ids), ids.flatten().cast(pa.int32())
        if ids.null_count or len(flat) != off[-1]:
            return pa.array([self._decode_one(x) for x in ids.to_pylist()], pa.string())
        at = flat.to_numpy(zero_copy_only=False)
        if flat.null_count or (len(at) and (at.min() < 0 or at.max() >= self.size)):
            return pa.array([self._decode_one(x) for x in ids.to_pylist()], pa.string())
        at = at.copy()
        at[off[:-1][np.diff(off) > 0]] += self.size
        pieces = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), self.raw.take(pa.array(at)))
        joined = pc.binary_join(pieces, b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # byte entries that are no UTF-8
            return pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())

    def _decode_one(self, ids: list[int | None] | None) -> str | None:
        if ids is None or any(i is None or not 0 <= i < self.size for i in ids):
            return None
        out = b"".join(self.raw[i].as_py() for i in ids)
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


#: Rows decoded at once.
DECODE_ROWS = 1024


def _coded(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


@functools.cache
def codec(path: str = MODEL) -> PieceCodec:
    """The codec of a model file, made once in a process."""
    return PieceCodec(path)


def encode_decode(df: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", count: str = "n_tokens", decoded: str | None = "decoded") -> DataFrame:
    """Add token ids, their number and (unless None) the text decoded from the ids, in place of the text column.

    One pass over the rows and no shuffle; the model file's path must be readable on every executor.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    taken = {f.name.lower() for f in kept}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        return name

    added = [T.StructField(free(ids), T.ArrayType(T.IntegerType(), True)), T.StructField(free(count), T.IntegerType())]
    if decoded is not None:
        added.append(T.StructField(free(decoded), T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for part in slices(batches, text, SLICE):
            place = part.schema.get_field_index(text)
            lists = tool.encode(part.column(place).cast(pa.string()))
            columns = [c for k, c in enumerate(part.columns) if k != place] + [lists, pc.list_value_length(lists)]
            if decoded is not None:
                columns.append(tool.decode(lists))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + [f.name for f in added])

    return df.select(*[f"`{f.name}`" for f in kept], f"`{text}`").mapInArrow(run, T.StructType([*kept, *added]))


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL, text: str = "decoded") -> DataFrame:
    """Add the text that lists of ids stand for, under a name that df hasn't (with underscores before it). A null list gives a null text, an empty one ''; rows in slices, so that memory follows the slice."""
    (name,), names = fresh(df, text), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            place = batch.schema.get_field_index(ids)
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, tool.decode(part.column(place))], names=[*names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
