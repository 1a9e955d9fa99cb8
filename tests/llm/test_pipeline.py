"""The corpus pipeline, stage by stage against brute force, and the SQL of the queries over the small tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from quillon.llm import near_dedup, queries
from tests.compare import database, difference
from tests.llm.test_operators import docs, edited, lines_by_hand, mixed_by_hand, near_by_hand, prose

SF = "/root/testdata/sf0.001"


def test_stages(spark: SparkSession, tmp_path) -> None:
    rows = [(i, f"{prose(i, 60)}\nread more here") for i in range(60)] + [(100 + i, f"{edited(prose(i, 60), 30, i)}\nread more here") for i in range(5)] + [(200, None), (201, "| | | |"), (202, "")]
    rows = [(i, t, "xx", "big" if i % 4 else "small") for i, t in rows]  # an invented language, without a list of stop words
    docs(spark, *rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    good = [(i, t) for i, t, *_ in rows if t and "|" not in t]
    lined = lines_by_hand(good, 50)
    gone = {i for g in near_by_hand(lined, near_dedup.THRESHOLD) for i in g if i != min(g)}
    want = mixed_by_hand([(i, t, "xx", "big" if i % 4 else "small") for i, t in lined if i not in gone])
    got = Counter((r["doc_id"], r["decoded"]) for r in out.collect())
    assert gone and got == want and not any("read more" in t for _, t in got)
    assert out.filter("size(ids) <> n_tokens").count() == 0


def test_large_groups_of_copies(spark: SparkSession, tmp_path) -> None:
    exact, near = [prose(500 + k, 40) for k in range(3)], [prose(600 + k, 40) for k in range(3)]
    rows = [(i, f"{prose(i, 60)}\nread more here") for i in range(60)] + [(100 + i, "\n".join(exact)) for i in range(60)]
    rows += [(200 + i, "\n".join([*near[: i % 3], prose(700 + i, 25), *near[i % 3 :]])) for i in range(60)] + [(300 + i, "\n".join([*near, ""] if i else near)) for i in range(2)]
    docs(spark, *((i, t, "xx", "s") for i, t in rows)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [r["decoded"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert [t for t in texts if exact[0] in t] == ["\n".join(exact)]
    assert all(sum(x in t for t in texts) == 1 for x in [*exact, *near, *(prose(i, 60) for i in range(60)), *(prose(700 + i, 25) for i in range(60))])
    assert all(t.strip() and "read more" not in t for t in texts)


def test_stages_by_name() -> None:
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark: SparkSession, name: str) -> None:
    assert difference(queries.QUERIES[name](spark, SF), database(SF), queries.SQL[name]) is None
