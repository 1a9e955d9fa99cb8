"""The training-data operators against brute force, round trips, and hard cases: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import chat, common, line_dedup, lm_score, mixing, near_dedup, quality, queries, self_score, sentencepiece_codec, sharding, suffix, suffix_dedup, topk
from tests.compare import difference

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def docs(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rows (doc_id, text[, lang, source]), and a column whose names helpers might want."""
    full = [(i, t, *(rest or ("en", "s")), len(t) if t is not None else None) for i, t, *rest in rows]
    d = spark.createDataFrame(full, DOCS)
    for name in ("key", "rate", "copies", "near_key", "line", "node", "rid", "ids", "drop", "fp", "pos"):
        d = d.withColumn(name, F.lit("x"))
    return d


HARD = [(1, None), (2, ""), (3, "  \n\n "), (4, prose(4, 60)), (4, prose(4, 60)), (5, prose(4, 60)), (None, prose(5, 80)), (None, None), (6, "word"), (7, "ab " * 30000), (8, prose(8, 20000)), (9, "é ▁ 漢字 \U0001f600 \x07")]


# 1 -------------------------------------------------------------------------------------------------------------------
def test_codec_is_the_librarys(spark: SparkSession) -> None:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    r = random.Random(1)
    texts = [t for _, t in HARD] + ["".join(r.choice("abcdefghij   .,ü漢1'\n") for _ in range(r.randrange(60))) for _ in range(400)] + ["a" * 500, "  two  spaces ", "▁mark", "x▁y"]
    tool = sentencepiece_codec.codec()
    got = tool.encode(pa.array(texts, pa.string()))
    assert got.to_pylist() == [None if t is None else model.encode(t) for t in texts]
    assert tool.decode(got).to_pylist() == [None if t is None else model.decode(model.encode(t)) for t in texts]


def test_codec_hard_rows(spark: SparkSession) -> None:
    d = docs(spark, *HARD)
    out = sentencepiece_codec.encode_decode(d)
    rows = out.collect()
    assert len(rows) == len(HARD) and "_ids" in out.columns and {"key", "rate", "n_tokens", "decoded"} <= set(out.columns)
    for r in rows:
        assert (r["_ids"] is None) == (r["decoded"] is None) == (r["n_tokens"] is None)
    assert Counter(r["decoded"] for r in rows) == Counter(t if t is None else t.replace("▁", " ") for _, t in HARD)
    assert sentencepiece_codec.encode_decode(d.limit(0)).count() == 0
    again = sentencepiece_codec.decode(out.select("_ids", "decoded"), "_ids")
    assert again.columns == ["_ids", "decoded", "_decoded"] and all(r["decoded"] == r["_decoded"] for r in again.collect())
    back = sentencepiece_codec.decode(out.select("_ids"), "_ids")
    assert back.filter("decoded is null").count() == 2


# 2 -------------------------------------------------------------------------------------------------------------------
def test_chat_spans(spark: SparkSession) -> None:
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, None, None, None), (None, 1, "user", "x" * 50000), (None, 1, "user", "y")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ord", F.lit(9)).withColumn("turns", F.lit("x"))
    out = chat.format_chats(d, (chat.marked_turns,)).orderBy("conv_id", "ord").collect()
    assert len(out) == len(rows) and not any(r["rewrites_history"] for r in out)
    one = [r for r in out if r["conv_id"] == 1]
    assert [r["turn"] for r in one] == [1, 1, 2] and one[0]["span_start"] == 0 and all(a["span_end"] == b["span_start"] for a, b in zip(one, one[1:]))
    assert one[-1]["span_end"] == len(chat.marked_turns([{"role": "user", "text": "a"}] * 2 + [{"role": "assistant", "text": "b"}]))
    assert chat.format_chats(d.limit(0)).count() == 0


def test_chat_rewritten_history() -> None:
    m = lambda *p: [{"role": r, "text": t} for r, t in p]
    found = chat.spans(m(("user", "q"), ("system", "rules"), ("assistant", "a")), chat.folded_system)
    assert [x[2] for x in found] == [False, True, False]
    found = chat.spans(m(("user", "q"), ("assistant", "think\nanswer"), ("user", "r"), ("assistant", "z")), chat.last_answer_whole)
    assert [x[2] for x in found] == [False, False, False, True]
    closing = lambda ms: chat.marked_turns(ms) + "<GO>"
    assert not any(x[2] for x in chat.spans(m(("user", "q"), ("assistant", "a")), closing, "<GO>"))


def test_chat_under_all_templates(spark: SparkSession, tmp_path) -> None:
    rows = [(1, 0, "user", "q"), (1, 1, "system", "rules"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "think\nanswer"), (2, 2, "user", "r"), (2, 3, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op2_chat_format"](spark, str(tmp_path)).collect()
    assert len(out) == 3 * len(rows) and {(r["template"], r["conv_id"], r["turn"]) for r in out if r["rewrites_history"]} == {("folded_system", 1, 1), ("last_answer_whole", 2, 3)}
    assert {(r["template"], r["conv_id"]) for r in out if r["conversation_rewritten"]} == {("folded_system", 1), ("last_answer_whole", 2)}


def test_chat_sql_on_hard_rows(spark: SparkSession, tmp_path) -> None:
    r = random.Random(2)
    rows = [(r.choice([None, 1, 2, 2**53 + 1, 2**53 + 2]), r.choice([None, 0, 1, 2, 3]), r.choice([None, "user", "system", "assistant"]), r.choice([None, "", "q", "a\nb", "é漢\n\n", "x" * 2000])) for _ in range(60)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    database = duckdb.connect()
    database.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    out = queries.QUERIES["op2_chat_format"](spark, str(tmp_path))
    assert difference(out, database, chat.SQL) is None
    assert out.filter("rewrites_history").count() and out.count() == 180


# 3 -------------------------------------------------------------------------------------------------------------------
def lines_by_hand(rows: list[tuple], most: int) -> list[tuple]:
    normal = lambda x: " ".join(x.split(" ")).strip().lower()
    seen: dict[str, set] = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if normal(line):
                seen[normal(line)].add((i, t))
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not normal(x) or len(seen[normal(x)]) <= most)) for i, t in rows]


def test_line_dedup(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rows = [(i, f"own {i}\n  Common Line \n\ntie") if i < 3 else (i, f"own {i}\ncommon line") for i in range(6)] + [(1, "own 1\n  Common Line \n\ntie"), (7, None), (8, ""), (None, "common line"), (9, "common line\n" * 3000 + "end")]
    out = line_dedup.line_dedup(docs(spark, *rows), max_docs=3)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=key) == sorted(lines_by_hand(rows, 3), key=key)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect()) and "line" in out.columns
    assert line_dedup.line_dedup(docs(spark, *rows).limit(0)).count() == 0
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert Counter((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs(spark, *rows), max_docs=3).collect()) == Counter(lines_by_hand(rows, 3))


# 4 -------------------------------------------------------------------------------------------------------------------
def passages_by_hand(rows: list[tuple], m: int) -> set[tuple]:
    """(doc_id, word, keep) of each word in a window that occurs twice."""
    texts = sorted({(i is not None, i if i is not None else 0, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1], common.xxhash.xxh64_intdigest(x[2])))
    where: dict[tuple, list] = defaultdict(list)
    for has, i, t in texts:
        w = t.split()
        for k in range(len(w) - m + 1):
            where[tuple(w[k : k + m])].append((has, i, t, k))
    out = set()
    for places in where.values():
        if len(places) > 1:
            for n, (has, i, _, k) in enumerate(places):
                out |= {(i if has else None, x, n == 0) for x in range(k, k + m)}
    return out


@pytest.mark.parametrize(("shard", "hot"), [(200, 10**9), (1 << 19, 10**9), (1 << 19, 3)])
def test_repeated_passages(spark: SparkSession, shard: int, hot: int) -> None:
    shared, other = prose(100, 70), prose(101, 55)
    rows = [(i, f"{prose(i, 40)} {shared} {prose(50 + i, 30)}") for i in range(8)] + [(20, f"{other} {prose(21, 9)} {other}"), (21, prose(22, 300)), (22, prose(23, 49)), (23, None), (24, ""), (25, "z " * 120), (26, prose(22, 300) + " more")]
    rows += [(27, prose(24, 20_000)), (28, prose(24, 20_000) + " end")]  # very long texts
    d = docs(spark, *rows)
    got = {(r["doc_id"], x, r["keep"]) for r in suffix_dedup.repeated_passages(d, shard_words=shard, hot=hot).collect() for x in range(r["start_word"], r["end_word"])}
    want = passages_by_hand(rows, 50)
    assert got == want
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.cut_passages(d, shard_words=shard, hot=hot).collect()}
    for i, t in rows:
        words = (t or "").split()
        assert (cut[i] or "").split() == [w for x, w in enumerate(words) if (i, x, False) not in want or (i, x, True) in want]
    assert cut[23] is None and cut[27] == rows[-2][1]


def test_passages_of_string_ids(spark: SparkSession) -> None:
    t = prose(7, 90)
    d = spark.createDataFrame([("b", t, "x"), ("a", t, "y"), (None, t + " z", "z"), ("c", None, None)], "doc_id string, text string, passage_key string")
    assert {(r["doc_id"], r["keep"]) for r in suffix_dedup.repeated_passages(d).collect()} == {(None, True), ("a", False), ("b", False)}
    out = suffix_dedup.cut_passages(d)
    assert out.columns == d.columns and Counter(tuple(r) for r in out.collect()) == Counter([("b", "", "x"), ("a", "", "y"), (None, t + " z", "z"), ("c", None, None)])
    assert suffix_dedup.repeated_passages(d.limit(0)).count() == 0 and suffix_dedup.cut_passages(d.limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark: SparkSession) -> None:
    t = prose(7, 90)
    assert suffix_dedup.repeated_passages(docs(spark, (1, t), (1, t))).count() == 0
    assert {(r["doc_id"], r["keep"]) for r in suffix_dedup.repeated_passages(docs(spark, (1, t), (2, t), (None, t))).collect()} == {(None, True), (1, False), (2, False)}
    assert suffix_dedup.cut_words("a  b c\nd", [(1, 3)]) == "a  d" and suffix_dedup.cut_words(" a b c", [(0, 2)], [(1, 2)]) == " b c"


def test_suffix_array_and_prefixes() -> None:
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 60, 300):
        for alphabet in (1, 2, 5):
            s = r.integers(0, alphabet, n)
            sa, rank = suffix.suffix_array(s)
            assert sa.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
            lcp = suffix.kasai(s, sa, rank)
            for k in range(1, n):
                a, b = s[sa[k - 1] :].tolist(), s[sa[k] :].tolist()
                want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[k] == want


# 5 -------------------------------------------------------------------------------------------------------------------
def topk_by_hand(rows: list[tuple], asked: list[tuple], k: int) -> Counter:
    """(id, rank, neighbour, score) of each query's k best rows."""
    out: Counter = Counter()
    for i, v in asked:
        a = np.array(v, np.float32).astype(float)
        found = [(-float(a @ np.array(w, np.float32).astype(float)), j is None, j if j is not None else type(i)(), j) for j, w in rows if (i is None or j != i) and len(w) == len(v)]
        for rank, (s, _, _, j) in enumerate(sorted(found)[:k], 1):
            out[i, rank, j, round(-s, 4)] += 1
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize(("k", "pack", "blocks"), [(10, 4096, (64, 4096)), (10, 16, (4, 8)), (200, 4096, (64, 4096))])
def test_top_k(spark: SparkSession, kind: str, k: int, pack: int, blocks: tuple[int, int]) -> None:
    r = np.random.default_rng(5)
    name = (lambda i: i) if kind == "bigint" else (lambda i: f"v{i}")
    vectors = [(name(i), [float(x) for x in np.round(v, 2)]) for i, v in enumerate(r.normal(size=(90, 8)))]
    vectors += [(name(200), vectors[0][1]), (name(201), vectors[0][1]), (name(0), vectors[3][1]), (name(7), vectors[7][1]), (None, vectors[4][1])]  # ties, one id on several rows, repeated rows
    bad = [(name(300), None), (name(301), []), (name(302), [float("nan")] * 8), (name(303), [1.0, None] + [0.0] * 6), (name(304), [1.0, 2.0])]
    d = spark.createDataFrame(vectors + bad, f"vec_id {kind}, embedding array<float>").withColumn("pack", F.lit(1)).withColumn("rank", F.lit("x"))
    got = Counter((x["vec_id"], x["rank"], x["neighbor_id"], round(x["score"], 4)) for x in topk.top_k(d, k=k, pack=pack, blocks=blocks).collect())
    assert got == topk_by_hand(vectors, vectors, k)
    some = [name(4), name(9), None]
    few = topk.top_k(d, k=k, queries=F.col("vec_id").isin(some[:2]) | F.col("vec_id").isNull(), pack=pack, blocks=blocks)
    assert Counter((x["vec_id"], x["rank"], x["neighbor_id"], round(x["score"], 4)) for x in few.collect()) == topk_by_hand(vectors, [x for x in vectors if x[0] in some], k)
    assert topk.top_k(d.limit(0)).count() == 0 and topk.top_k(d, queries=F.lit(False)).count() == 0


def test_lists_are_read_in_part() -> None:
    r = np.random.default_rng(6)
    for rows, most in ((r.normal(size=(3000, 32)), 0.95), (r.normal(size=(20, 1, 32)).repeat(150, 1).reshape(-1, 32) + 0.1 * r.normal(size=(3000, 32)), 0.6)):
        rows = rows.astype(np.float32)
        lists = topk.Lists(rows)
        for q in rows[::500].astype(float):
            best = np.argsort(-(lists.rows @ q), kind="stable")[:10]
            found, read, _ = topk.nra(q, lists, 10)
            assert set(best) <= set(found.tolist()) and read <= most * rows.size
            floor = float(lists.rows[best[-1]] @ q)
            found, again, _ = topk.nra(q, lists, 10, floor)
            assert set(best) <= set(found.tolist()) and again <= read
            assert topk.nra(q, lists, 10, 1e9)[1] == 0  # no row can have that score: nothing is read


# 6 -------------------------------------------------------------------------------------------------------------------
def test_kd_shards(spark: SparkSession) -> None:
    rows = [(i, "x" * (10 + i % 7), ("en", "de", "fr")[i % 3], f"s{i % 5}") for i in range(200)] + [(None, None, None, None), (3, "", "en", "s1")] + [(999, "y" * 50, "en", "s1")] * 20
    d = docs(spark, *rows)
    out = sharding.kd_shards(d, target_bytes=400)
    got = [(r["doc_id"], r["n_bytes"], r["shard"]) for r in out.collect()]
    assert Counter((i, n) for i, n, _ in got) == Counter((i, len((t or "").encode())) for i, t, *_ in rows)
    size: Counter = Counter()
    for _, n, s in got:
        size[s] += n
    same = [s for i, _, s in got if i == 999]
    assert len(set(same)) == 1 and all(n <= 400 or s == same[0] for s, n in size.items())  # equal rows stay together
    leaves = set(size)
    assert not any(s >> k in leaves for s in leaves for k in range(1, s.bit_length()))  # no leaf above another
    assert sharding.kd_shards(d.limit(0)).count() == 0 and {r["shard"] for r in sharding.kd_shards(d, target_bytes=1 << 30).collect()} == {1}


def shards_by_hand(rows: list[tuple], sizes: list[int], target: int) -> list[int]:
    """Each row's shard: rows of dimension values, split one node after the other."""
    width = len(rows[0])
    coded = []
    for k in range(width):
        there = sorted({r[k] for r in rows if r[k] is not None})
        code = {v: v if isinstance(v, int) else n for n, v in enumerate(there)}
        coded.append([code[r[k]] if r[k] is not None else min(code.values(), default=1) - 1 for r in rows])
    span = [max(1, max(c) - min(c)) for c in coded]
    out, todo = [0] * len(rows), [(1, list(range(len(rows))))]
    while todo:
        node, own = todo.pop()
        wide = [(max(c[i] for i in own) - min(c[i] for i in own)) / s for c, s in zip(coded, span)]
        if sum(sizes[i] for i in own) <= target or max(wide) == 0:
            for i in own:
                out[i] = node
            continue
        c = coded[wide.index(max(wide))]
        upto, half = 0, sum(sizes[i] for i in own) / 2
        for i in sorted(own, key=lambda i: c[i]):
            upto += sizes[i]
            if upto >= half:
                middle = c[i]
                break
        right = {i for i in own if (c[i] > middle if middle < max(c[i] for i in own) else c[i] >= middle)}
        todo += [(2 * node, [i for i in own if i not in right]), (2 * node + 1, list(right))]
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_kd_shards_by_hand(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, broadcast: bool) -> None:
    if not broadcast:
        monkeypatch.setattr(sharding, "BROADCAST_NODES", 0)
    r = random.Random(6)
    names = ["https://example.org/a", "https://example.org/b", "https://example.org/ab", "common_crawl_a", "common_crawl_b", "", "é", None]
    rows = [(r.choice(names), r.choice([-2, -1, 0, 5, 2**62, None]), r.choice([0.1, 0.2, 0.25, -0.5, 7.5, None]), r.randrange(10**6)) for _ in range(300)] + [("common_crawl_a", 1, 0.1, 3)] * 30
    texts = [r.choice([None, "", "x" * r.randrange(60), "é" * 20]) for _ in rows] + []
    texts[7] = "y" * 200_000  # a very long text
    d = spark.createDataFrame([(k, t, *x) for k, (t, x) in enumerate(zip(texts, rows))], "doc_id bigint, text string, source string, whole bigint, share double, far bigint").withColumn("node", F.lit("x")).withColumn("at", F.lit(0)).withColumn("value0", F.lit(0))
    sizes = [len((t or "").encode()) for t in texts]
    got = {x["doc_id"]: (x["n_bytes"], x["shard"]) for x in sharding.kd_shards(d, 1500, ("source", "whole", "share", "far")).collect()}
    assert [got[k] for k in range(len(rows))] == list(zip(sizes, shards_by_hand(rows, sizes, 1500)))
    only = {x["doc_id"]: x["shard"] for x in sharding.kd_shards(d, 1500, ("source",)).collect()}  # long common prefixes are told apart
    assert [only[k] for k in range(len(rows))] == shards_by_hand([x[:1] for x in rows], sizes, 1500) and len(set(only.values())) == len(names)


# 7 -------------------------------------------------------------------------------------------------------------------
def test_quality(spark: SparkSession) -> None:
    good = "The quick brown fox jumps over the lazy dog. It was a bright day in the town, and people were out."
    bad = ["", "   ", None, "#$% " * 20, "A | b | c | d", "ALL CAPITALS HERE", "no ! ! ! !", "same same same same same", "x y\n" * 9, ("one two three four " * 12).strip()]
    bad += ["- one\n* two\n• three, the last", "so it goes...\nand on…\nto the end", " ".join(f"{k}." for k in range(40)), " ".join("ab" * 9 + str(k) for k in range(40)), prose(9, 60)]
    rows = [(i, t) for i, t in enumerate(bad)] + [(50, good), (50, good), (51, "short"), (None, good), (52, prose(9, 20000), "xx", "s")]
    d = docs(spark, *rows)
    out = quality.quality_filter(d)
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted((str(i), t) for i, t, *_ in rows if i is None or i >= 50) and out.columns == d.columns
    order = quality.measure(d)
    assert len(order) == 13 and sum(x[2] for x in order) == pytest.approx(0.75)  # each rejected row counts for the first rule only
    assert quality.quality_filter(d.limit(0)).count() == 0
    for name in quality.rules(F.lit(""), lang=F.lit("en")):  # whatever the order, the same rows stay
        kept = d.filter(quality.first_failure(F.col("text"), sorted([n for n, _, _ in order], key=lambda n: (n != name, n)), lang=F.col("lang")).isNull())
        assert kept.count() == 5


# 8 -------------------------------------------------------------------------------------------------------------------
def score_by_hand(texts: list[tuple], corpus: list[str | None]) -> list[tuple]:
    lists = [(t or "").lower().split() for t in corpus]
    total = sum(map(len, lists))

    def count(g: list[str]) -> int:
        return sum(w[i : i + len(g)] == g for w in lists for i in range(len(w) - len(g) + 1)) if g else total

    out = []
    for i, t in texts:
        w = (t or "").lower().split()
        for k in range(len(w)):
            p, match = (count([w[k]]) + 1) / (total + lm_score.VOCABULARY), 0
            for n in range(1, k + 1):
                c = count(w[k - n : k])
                if not c:
                    break
                p, match = (count(w[k - n : k + 1]) + p) / (c + 1), n
            out.append((i, k, w[k], match, count(w[k - match : k]), count(w[k - match : k + 1]), round(math.log(p), 9)))
    return out


def scored(df: DataFrame) -> list[tuple]:
    return sorted(((x["doc_id"], x["n_words"], [(m, c, f, round(p, 9)) for m, c, f, p in zip(x["match_words"], x["context_count"], x["next_count"], x["log_probs"])]) for x in df.collect()), key=lambda x: (str(x[0]), x[1], str(x[2])))


def scored_by_hand(texts: list[tuple], corpus: list[str | None]) -> list[tuple]:
    want = defaultdict(list)
    for j, _, _, *rest in score_by_hand([(j, t) for j, (_, t) in enumerate(texts)], corpus):
        want[j].append(tuple(rest))
    return sorted(((i, len(want[j]), want[j]) for j, (i, _) in enumerate(texts)), key=lambda x: (str(x[0]), x[1], str(x[2])))


@pytest.mark.parametrize(("shard", "block", "levels"), [(1 << 20, 1 << 20, 4), (30, 12, 2), (100, 40, 1)])
def test_lm_scores(spark: SparkSession, shard: int, block: int, levels: int) -> None:
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("a b c d".split()) for _ in range(n))
    corpus = [say(r.randrange(40)) for _ in range(12)] + [None, "", "A b A b A b", "lone"]
    corpus += corpus[-2:-1]
    texts = [(1, say(15)), (2, corpus[0] + " zzz a"), (3, None), (4, ""), (5, "a b"), (5, "a b"), (None, "lone"), (6, f"{corpus[1]} {corpus[2]}")]
    t = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("pos", F.lit("x")).withColumn("block", F.lit(1))
    c = spark.createDataFrame([(x,) for x in corpus], "text string").withColumn("n", F.lit(0))
    assert scored(lm_score.lm_scores(t, c, shard_words=shard, block_words=block, levels=levels)) == scored_by_hand(texts, corpus)
    if levels == 4:
        assert lm_score.lm_scores(t.limit(0), c).count() == 0
        alone = lm_score.lm_scores(t.filter("doc_id = 2"), c.limit(0)).head()
        assert all(abs(p + math.log(lm_score.VOCABULARY)) < 1e-9 for p in alone["log_probs"])


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 20), (60, 100)])
def test_documents_are_scored_against_all(spark: SparkSession, shard: int, block: int) -> None:
    r = random.Random(9)
    say = lambda n: " ".join(r.choice("a b c d".split()) for _ in range(n))
    long = prose(3, 45)
    rows = [(f"d{i}", say(r.randrange(30))) for i in range(12)] + [("20", None), ("21", ""), ("22", "A b A b A b"), ("22", "A b A b A b"), (None, "lone"), ("23", long), ("24", edited(long, 30, 1)), ("25", f"{say(3)} {long}"), ("26", long), ("27", "z " * 60)]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("ids", F.lit(0))
    assert scored(lm_score.lm_scores(d, d, shard_words=shard, block_words=block)) == scored_by_hand(rows, [t for _, t in rows])


@pytest.mark.parametrize(("block", "keys"), [(1 << 20, 1 << 20), (60, 50), (7, 1000)])
def test_all_documents_are_scored_without_pairs_of_blocks(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, block: int, keys: int) -> None:
    r = random.Random(10)
    say = lambda n: " ".join(r.choice("a b c d".split()) for _ in range(n))
    long = prose(4, 90)
    rows = [(f"d{i}", say(r.randrange(30))) for i in range(12)] + [("20", None), ("21", ""), ("22", "A b A b A b"), ("22", "A b A b A b"), (None, "lone"), ("23", long), ("24", edited(long, 30, 1)), ("25", f"{say(3)} {long}"), ("26", long), ("27", "z " * 60), ("28", f"{long} {long}")]
    d = spark.createDataFrame(rows, "doc_id string, text string").withColumn("ids", F.lit(0)).withColumn("block", F.lit("x"))
    schema = lm_score.result_schema(d.schema["doc_id"].dataType)
    monkeypatch.setattr(self_score, "RANGE_KEYS", keys)
    assert scored(self_score.self_scores(d, schema, lm_score.GAMMA, lm_score.VOCABULARY, block_words=block)) == scored_by_hand(rows, [t for _, t in rows])
    if keys == 50:
        monkeypatch.setattr(lm_score, "lm_scores", None)  # each block against each shard: work that grows with the square
        assert scored(lm_score.document_scores(d)) == scored_by_hand(rows, [t for _, t in rows])
        assert lm_score.document_scores(d.limit(0)).count() == 0
        assert scored(lm_score.document_scores(d.filter("doc_id in ('20', '21')"))) == [("20", 0, []), ("21", 0, [])]


def test_scoring_keeps_no_shuffle_and_the_words_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """What lies on disk between rounds: the blocks, answers and one state, no files of shuffles that are over."""
    folders = [Path(str(x)) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {x for f in folders for x in f.rglob("shuffle_*.data")}
    before, made, left, real = shuffles(), [], [], self_score.checkpoint

    def watched(df: DataFrame) -> DataFrame:
        made.append(out := real(df))
        for _ in range(50):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        left.append(shuffles() - before)
        return out

    monkeypatch.setattr(self_score, "checkpoint", watched)
    d = spark.createDataFrame([(k, f"start{k} {prose(k // 2, 120)}") for k in range(30)], "doc_id bigint, text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    out = self_score.self_scores(d, lm_score.result_schema(T.LongType()), lm_score.GAMMA, lm_score.VOCABULARY, block_words=300)
    assert not any(left) and sum("tokens" in x.columns for x in made) == 1
    there = [x for x in made if "kind" in x.columns and Path(x._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")).exists()]
    assert len(there) == 1 and len(made) > 6
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive and out.count() == 30


def test_a_very_long_text_is_scored(spark: SparkSession) -> None:
    long = prose(1, 30_000)
    d = spark.createDataFrame([(1, long), (2, long), (3, "alpha1 bravo2")], "doc_id bigint, text string")
    x = lm_score.document_scores(d, F.col("doc_id") == 1).head()
    assert x["n_words"] == 30_000 and x["match_words"] == list(range(30_000)) and x["context_count"][-1] == 2


def test_every_document_is_scored(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.001"
    got = Counter(x["doc_id"] for x in queries.QUERIES["op8_lm_scores"](spark, sf).select("doc_id").collect())
    assert got == Counter(x["doc_id"] for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


# 9 -------------------------------------------------------------------------------------------------------------------
def mixed_by_hand(rows: list[tuple], alpha: float = mixing.ALPHA) -> Counter:
    import hashlib

    tokens: Counter = Counter()
    for _, t, _, s in rows:
        tokens[s] += len((t or "").split())
    raw = {s: n**alpha if n else 0.0 for s, n in tokens.items()}
    out: Counter = Counter()
    for i, t, _, s in rows:
        rate = raw[s] / sum(raw.values()) * sum(tokens.values()) / tokens[s] if tokens[s] else 1.0
        u = int(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out[i, t] += math.floor(rate) + (u < rate - math.floor(rate))
    return +out


def test_mixing(spark: SparkSession) -> None:
    rows = [(i, prose(i, 5 + i % 9), "en", "hot" if i % 10 else "cold") for i in range(120)] + [(500, None, "en", "void"), (501, "", "en", "void"), (None, "a b", "en", None), (3, "a b c", "en", "hot"), (3, "a b c", "en", "hot")]
    d = docs(spark, *rows)
    out = mixing.mix(d)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == mixed_by_hand(rows) and out.columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0
    only = mixing.mix(d, weights={"cold": 1.0}, total=240.0)
    assert {r["source"] for r in only.collect()} == {"cold", "void"} and only.count() > 20


# 10 ------------------------------------------------------------------------------------------------------------------
def near_by_hand(rows: list[tuple], threshold: float) -> set[frozenset]:
    """Groups of doc_ids, linked by Jaccard similarity of word triples."""
    sets = {}
    for i, t in rows:
        w = [x for x in ((y.strip(near_dedup._EDGE)) for y in (t or "").lower().split()) if x]
        if w:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    groups = defaultdict(set)
    for k, v in label.items():
        groups[v].add(k)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def edited(t: str, every: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("changed" + str(r.randrange(10**6)) if k % every == 5 else w for k, w in enumerate(t.split()))


def test_near_dedup(spark: SparkSession) -> None:
    rows = [(i, prose(1000 + i, 120)) for i in range(30)]
    rows += [(100 + i, edited(prose(1000 + i, 120), 40, i)) for i in range(8)] + [(200 + i, prose(1000, 120)) for i in range(40)] + [(300, prose(1001, 120).upper() + "!")]
    rows += [(400, None), (401, ""), (402, "..."), (403, "two words"), (404, "Two words."), (405, prose(77, 20000)), (406, edited(prose(77, 20000), 200, 1))]
    d = docs(spark, *rows)
    found = defaultdict(set)
    for r in near_dedup.groups(d).collect():
        found[r["group_id"]].add(r["doc_id"])
        assert r["keep"] == (r["doc_id"] == r["group_id"])
    assert {frozenset(g) for g in found.values()} == near_by_hand(rows, near_dedup.THRESHOLD)
    kept = {r["doc_id"] for r in near_dedup.drop_near_copies(d).collect()}
    gone = {i for g in near_by_hand(rows, near_dedup.THRESHOLD) for i in g if i != min(g)}
    assert kept == {i for i, _ in rows} - gone
    assert near_dedup.groups(d.limit(0)).count() == 0 and near_dedup.drop_near_copies(d.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, near_dedup.BLOCK])
def test_near_dedup_in_hot_buckets(spark: SparkSession, block: int) -> None:
    """Texts from a few templates: their similarities lie on both sides of the threshold, and buckets hold many groups."""
    r = random.Random(4)
    frames = [prose(900 + k, 160).split() for k in range(2)]
    rows = [(i, " ".join(w if r.random() > share else f"own{r.randrange(10**6)}" for w in frames[i % 2])) for i in range(120) for share in [r.choice([0.02, 0.2, 0.4])]]
    found = defaultdict(set)
    for x in near_dedup.groups(docs(spark, *rows), block=block).collect():
        found[x["group_id"]].add(x["doc_id"])
    assert {frozenset(g) for g in found.values()} == near_by_hand(rows, near_dedup.THRESHOLD)


def test_near_dedup_repeated_rows(spark: SparkSession) -> None:
    t = prose(1, 50)
    d = docs(spark, (1, t), (1, t), (None, t), (None, None), (2, ""), (2, ""))
    left = Counter((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(d).collect())
    assert left == Counter({(1, t): 1, (None, None): 1, (2, ""): 2})


def test_near_dedup_repeated_rows_in_other_scripts(spark: SparkSession) -> None:
    texts = ["быстрая лиса прыгает через ленивую собаку", "η γρήγορη αλεπού πηδά", "敏捷的棕色狐狸", "الثعلب البني السريع", "→ ☃"]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(9, "... _ -"), (9, "... _ -")]
    left = Counter((r["doc_id"], r["text"]) for r in near_dedup.drop_near_copies(docs(spark, *rows)).collect())
    assert left == Counter({**{x: 1 for x in rows[:5]}, (9, "... _ -"): 2})


def test_estimates_and_merging() -> None:
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**32, 900, np.uint32), r.integers(0, 2**32, 900, np.uint32)
    for shared in (0, 300, 600, 850):
        y = np.concatenate([a[:shared], b[shared:]])
        off = np.array([0, 900, 1800])
        s = near_dedup.sketch(off, np.concatenate([a, y]))
        j = near_dedup.likelihood_estimate(*[np.array([v]) for v in ((s[0] > s[1]).sum(), (s[0] < s[1]).sum(), (s[0] == s[1]).sum(), 900, 900)])[0]
        assert abs(j - shared / (1800 - shared)) < near_dedup.MARGIN
        both = near_dedup.sketch(np.array([0, 1800]), np.concatenate([a, y]))[0]
        assert (both == np.maximum(s[0], s[1])).all()


def test_components(spark: SparkSession) -> None:
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["node"]: x["label"] for x in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
