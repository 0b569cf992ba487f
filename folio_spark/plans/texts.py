"""Queries of the text functions, over documents with known noise added."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from .pages import clean_sql
from .registry import query

NOISY_SQL = r"""WITH noisy AS (SELECT doc_id, replace(text, '. ', '.   ' || chr(12288)) || chr(13) || chr(10) || 'hy-' || chr(10) || 'phen'
  || chr(1) || chr(13) || doc_id || chr(10) || '-----' || chr(10) || '# Part' || chr(10) || 'end' AS t FROM documents)
"""


def noisy():
    """Documents carry no noise of their own, so a tail with every kind is added."""
    tail = [F.lit("\r\nhy-\nphen\x01\r"), F.col("doc_id"), F.lit("\n-----\n# Part\nend")]
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(".   　"))
    return F.concat(spaced, *tail)


@query("clean_text", NOISY_SQL + f"SELECT doc_id, {clean_sql('t')} AS text FROM noisy")
def clean_text(t):
    return t.spread("documents").select("doc_id", X.clean_text(noisy()).alias("text"))


HEADING_SQL = """regexp_matches(line, '^第.+[章節部]') OR (trim(line) <> '' AND length(line) <= 30
   AND NOT regexp_matches(line, '[。．.!?、]$') AND line[1] <> '#' AND (nxt IS NULL OR trim(nxt) = ''))"""
NOISE_LINES_SQL = r"""array_to_string(list_filter(string_split(t, chr(10)), lambda s:
  NOT regexp_matches(s, '^\s*[0-9]+\s*$') AND NOT regexp_matches(s, '^\s*[-=_*#~.]{3,}\s*$')), chr(10))"""


@query("noise_lines", NOISY_SQL + f", c AS (SELECT doc_id, {clean_sql('t')} AS t FROM noisy) SELECT doc_id, {NOISE_LINES_SQL} AS text FROM c")
def noise_lines(t):
    return t.spread("documents").select("doc_id", X.drop_noise_lines(X.clean_text(noisy())).alias("text"))


def runs_sql(source, name):
    """Runs of five and more equal characters out, by islands: the SQL has no back-references."""
    return f"""chars_{name} AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch, unnest(range(length(text))) AS i FROM {source}),
isles_{name} AS (SELECT doc_id, ch, i, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS isle FROM chars_{name}),
counted_{name} AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ch, isle) AS n FROM isles_{name}),
{name} AS (SELECT doc_id, coalesce(string_agg(ch, '' ORDER BY i) FILTER (n < 5 OR ch = chr(10)), '') AS text FROM counted_{name} GROUP BY doc_id)
"""


@query("remove_artifacts", NOISY_SQL + f", c AS (SELECT doc_id, {clean_sql('t')} AS t FROM noisy), kept AS (SELECT doc_id, {NOISE_LINES_SQL} AS text FROM c), "
       + runs_sql("kept", "out") + "SELECT doc_id, text FROM out")
def remove_artifacts(t):
    return t.spread("documents").select("doc_id", X.remove_artifacts(X.clean_text(noisy())).alias("text"))


@query("paragraphs", """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, pos // 3 ORDER BY pos) AS prev FROM d),
g AS (SELECT doc_id, pos // 3 AS para, string_agg(CASE WHEN prev IS NULL THEN '' WHEN length(prev) > 50 THEN '' ELSE chr(10) END || line, '' ORDER BY pos) AS body
  FROM p GROUP BY ALL)
SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY para) AS text FROM g GROUP BY doc_id
""")
def paragraphs(t):
    """Every third line ends a paragraph, with one or three blank lines behind it."""
    lines = F.split("text", "\n")
    gap = lambda i: F.when(i == 0, "").when(i % 6 == 0, "\n\n\n\n").when(i % 3 == 0, "\n\n").otherwise("\n")
    text = F.array_join(F.transform(lines, lambda s, i: F.concat(gap(i), s)), "")
    return t.spread("documents").select("doc_id", X.organize_paragraphs(text).alias("text"))


@query("headings_plain", """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
s AS (SELECT doc_id, pos * 2 AS pos, CASE WHEN pos % 7 = 0 THEN '第' || pos || '章 ' || line WHEN pos % 2 = 0 THEN rtrim(line, '.') ELSE line END AS line,
        pos % 3 = 0 AS gap FROM d),
x AS (SELECT doc_id, pos, line FROM s UNION ALL SELECT doc_id, pos + 1, '' FROM s WHERE gap),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM x)
SELECT doc_id, string_agg(CASE WHEN HEADING THEN '## ' || line ELSE line END, chr(10) ORDER BY pos) AS text
FROM n GROUP BY doc_id
""".replace("HEADING", HEADING_SQL))
def headings_plain(t):
    """Chapter marks, bare line ends and blank lines are put into the documents first."""

    def shape(line, i):
        chapter = F.concat(F.lit("第"), i.cast("string"), F.lit("章 "), line)
        bare = F.when(i % 7 == 0, chapter).when(i % 2 == 0, F.rtrim(line, F.lit("."))).otherwise(line)
        return F.when(i % 3 == 0, F.concat(bare, F.lit("\n"))).otherwise(bare)

    text = F.array_join(F.transform(F.split("text", "\n"), shape), "\n")
    return t.spread("documents").select("doc_id", X.format_headings(text).alias("text"))


@query("format_full", NOISY_SQL + f""", c AS (SELECT doc_id, {clean_sql('t')} AS t FROM noisy),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM c),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM l),
h AS (SELECT doc_id, string_agg(CASE WHEN {HEADING_SQL} THEN '## ' || line ELSE line END, chr(10) ORDER BY pos) AS t FROM n GROUP BY doc_id),
kept AS (SELECT doc_id, {NOISE_LINES_SQL} AS text FROM h), {runs_sql("kept", "bare")},
squeezed AS (SELECT doc_id, regexp_replace(text, chr(10) || '{{3,}}', chr(10) || chr(10), 'g') AS text FROM bare),
paras AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS para, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS no FROM squeezed),
pl AS (SELECT doc_id, no, unnest(string_split(para, chr(10))) AS line, unnest(range(len(string_split(para, chr(10))))) AS pos FROM paras),
pp AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, no ORDER BY pos) AS prev FROM pl),
joined AS (SELECT doc_id, no, string_agg(CASE WHEN prev IS NULL THEN '' WHEN length(prev) > 50 AND prev[1] <> '#' AND line[1] <> '#' THEN '' ELSE chr(10) END || line, '' ORDER BY pos) AS para
  FROM pp GROUP BY doc_id, no)
SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY no) AS text FROM joined GROUP BY doc_id
""")
def format_full(t):
    return t.spread("documents").select("doc_id", X.format_full_text(noisy()).alias("text"))


@query("toc", """
WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, coalesce(string_agg(repeat('  ', ((pos // 2) % 3)::INT) || '- ' || line, chr(10) ORDER BY pos) FILTER (pos % 2 = 0), '') AS toc
FROM d GROUP BY doc_id
""")
def toc(t):
    """Every second line becomes a heading of level 1, 2 or 3."""

    def shape(line, i):
        marks = F.repeat(F.lit("#"), (F.floor(i / 2) % 3 + 1).cast("int"))
        return F.when(i % 2 == 0, F.concat(marks, F.lit(" "), line)).otherwise(line)

    text = F.array_join(F.transform(F.split("text", "\n"), shape), "\n")
    return t.spread("documents").select("doc_id", X.table_of_contents(text).alias("toc"))
