"""Line dedup: windows of three consecutive lines that occur earlier in the corpus lose all the lines they cover.

Lines are what newlines separate, compared byte for byte; an empty or null text has none. A window of blank lines only
does not count. The first occurrence (smallest id, then earliest line) stays, every later one goes, overlapping windows
merging their positions. Texts of fewer than three lines stay. See ``repeats`` for hot windows and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tensorloom.llm.repeats import Units, digests, without_repeats

WINDOW = 3


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with later occurrences removed, kept lines joined by newlines."""
    return without_repeats(docs, Units(window, lines=True), id_col, text_col)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id_col, n_lines, n_removed, kept_sha256) of every row, of the kept lines joined by newlines."""
    return digests(docs, Units(window, lines=True), id_col, text_col).withColumnRenamed("n_units", "n_lines")


SQL = """
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents where length(text) > 0),
win as (
  select doc_id, i, line, lead(line, 1) over w as l2, lead(line, 2) over w as l3 from lines window w as (partition by doc_id order by i)),
seen as (
  select doc_id, i, row_number() over (partition by line, l2, l3 order by doc_id, i) > 1 as late
  from win where l3 is not null and regexp_matches(line || l2 || l3, '[^ \\t-\\r]')),
flag as (
  select w.doc_id, w.i, w.line, coalesce(bool_or(s.late) over (partition by w.doc_id order by w.i rows between 2 preceding and current row), false) as gone
  from win w left join seen s on s.doc_id = w.doc_id and s.i = w.i),
per as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '') as kept
  from flag group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join per p on p.doc_id = d.doc_id
"""
