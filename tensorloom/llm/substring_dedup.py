"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeats merge into intervals.

A word covered by a window (20 words) whose word sequence also starts earlier, in a smaller id or earlier in the same
text, is removed; windows are judged on the input. See ``repeats`` for the counting and for nulls and repeated rows:
null and empty texts have no words, texts of fewer words than a window lose none, and one very long text is one chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tensorloom.llm.repeats import Units, digests, without_repeats

WINDOW = 20


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages removed; a text that loses words is its kept words joined by one blank."""
    return without_repeats(docs, Units(window), id_col, text_col)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of every row, of the kept words joined by one blank."""
    return digests(docs, Units(window), id_col, text_col).withColumnRenamed("n_units", "n_words")


SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i+19], ' ') as k from w, unnest(range(1, len(w) - 18)) as t(i)),
late as (select doc_id, i from win qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, i + j as p from late, unnest(range(0, 20)) as t(j)),
per as (
  select doc_id, count(g.p) as n_removed, coalesce(string_agg(w[p], ' ' order by p) filter (where g.p is null), '') as kept
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from w) as a left join gone as g using (doc_id, p) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join per on per.doc_id = w.doc_id
"""
