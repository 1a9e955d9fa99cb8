"""Operator 3: drop lines that very many documents share.

Lines are normalised (white space at the ends off, runs of it to one space, lower case) and hashed to 128 bits; documents
are counted per hash; lines whose hash is in more than max_docs distinct documents go; what is left is put together by
position. Only hashes and positions are shuffled, and texts once, by document key, to meet the positions to drop.

Results: a null text stays null; an empty or blank line is neither counted nor dropped; a document that loses all its lines
keeps ''. n_chars, where there is one, is the new text's length (null for a null text). A document is a distinct pair of id and text,
so repeated rows count once and get the same result, and rows with a null id count by their text. A tie (a line in
exactly max_docs documents) stays. Extra columns are kept, clashing helper names avoided; an empty table gives an
empty table.

With copies_once (the pipeline's way) large groups of copies keep their content: documents are distinct texts, so that exact copies count once,
whatever their ids. Where lines to drop make at least half of a document (by characters that aren't white space), it is taken for one of many near copies:
of each such line, one of these documents (the least by key) keeps it. A document that loses all its lines to others goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, row_check, row_key, small_enough

#: Lines in more documents than this are boilerplate. Copies of whole documents are left to near-dedup, so it is high.
MAX_DOCS = 50
#: Common lines (16 bytes each) and bytes of positions to drop that are sent to every executor.
BROADCAST_LINES, BROADCAST_BYTES = 200_000, 16 << 20


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " ")))


def _solid(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"\s+", ""))


def line_dedup(df: DataFrame, max_docs: int = MAX_DOCS, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", copies_once: bool = False) -> DataFrame:
    key, check, pos, line, one, two, drop, docs, size, whole, keeper = fresh(df, "key", "check", "pos", "line", "one", "two", "drop", "docs", "size", "whole", "keeper")
    identity = (text,) if copies_once else (doc_id, text)
    keyed = df.withColumn(key, row_key(*identity)).withColumn(check, row_check(*identity))
    lines = (
        keyed.select(key, check, _solid(F.col(text)).alias(whole), F.posexplode(F.split(F.col(text), "\n")).alias(pos, line))
        .withColumn(line, normal_line(F.col(line)))
        .filter(F.col(line) != "")
        .select(key, check, pos, F.xxhash64(line).alias(one), F.xxhash64(F.lit(1), F.reverse(line)).alias(two), _solid(F.col(line)).alias(size), whole)
    )
    common = checkpoint(lines.select(one, two, key).distinct().groupBy(one, two).agg(F.count(F.lit(1)).alias(docs)).filter(F.col(docs) > max_docs).select(one, two))
    hits = lines.join(F.broadcast(common) if small_enough(common, BROADCAST_LINES) else common, [one, two], "left_semi")
    if copies_once:
        hits = hits.dropDuplicates([key, check, pos]).withColumn(docs, F.sum(size).over(Window.partitionBy(key, check)))
        keepers = hits.filter(F.col(docs) * 2 >= F.col(whole)).groupBy(one, two).agg(F.min(F.struct(key, check)).alias(keeper))
        hits = hits.join(keepers, [one, two], "left").filter(F.col(keeper).isNull() | (F.col(keeper) != F.struct(key, check)))
    drops = checkpoint(hits.groupBy(key, check).agg(F.collect_set(pos).alias(drop)))
    bytes_ = drops.agg(F.sum(F.size(drop) * 4 + 32)).head()[0] or 0
    joined = keyed.join(F.broadcast(drops) if bytes_ <= BROADCAST_BYTES else drops, [key, check], "left")
    kept = F.array_join(
        F.filter(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.when(F.array_contains(drop, i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull()), "\n"
    )
    if copies_once:
        joined = joined.filter(F.col(drop).isNull() | (_solid(kept) > 0))
    new = F.when(F.col(drop).isNull(), F.col(text)).otherwise(kept)
    out = {text: new}
    if n_chars is not None and n_chars in df.columns:
        out[n_chars] = F.when(F.col(drop).isNull(), F.length(text).cast(df.schema[n_chars].dataType)).otherwise(F.length(kept).cast(df.schema[n_chars].dataType))
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


SQL = rf"""
WITH lines AS (
  SELECT doc_id, text, i, string_split(text, chr(10))[i] AS raw,
         lower(trim(regexp_replace(string_split(text, chr(10))[i], '[ \t\r\f]+', ' ', 'g'), ' ')) AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
common AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT (doc_id, text)) > {MAX_DOCS}),
kept AS (
  SELECT doc_id, text, string_agg(raw, chr(10) ORDER BY i) AS new
  FROM lines WHERE line NOT IN (SELECT line FROM common) GROUP BY doc_id, text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.new, '') END AS text, d.lang, d.source,
       CASE WHEN d.text IS NULL THEN NULL ELSE length(coalesce(k.new, '')) END::BIGINT AS n_chars
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""
