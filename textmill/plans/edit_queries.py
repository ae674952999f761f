"""Edits, normal forms and differences over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit as ed
from .catalogue import query
from .corpus_queries import corpus

PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path"
COUNT = "CAST((len(text) - len(replace(text, '{0}', ''))) / len('{0}') AS BIGINT)"


@query("edit_replace_all", f"SELECT {PATH}, CASE WHEN contains(text, 'the') THEN 'ok' ELSE 'noMatch' END AS status, {COUNT.format('the')} AS replacements, CAST(strlen(replace(text, 'the', 'THEM')) AS BIGINT) AS byte_len, replace(text, 'the', 'THEM') AS text FROM documents")
def edit_replace_all(spark, sf_dir):
    return ed.edit(corpus(spark, sf_dir), "the", "THEM", replace_all=True)


@query("edit_count_status", f"WITH n AS (SELECT {PATH}, text, {COUNT.format('tion.')} AS n FROM documents) SELECT path, CASE n WHEN 0 THEN 'noMatch' WHEN 1 THEN 'ok' ELSE 'multipleMatches' END AS status, CASE n WHEN 1 THEN n ELSE 0 END AS replacements, CAST(strlen(CASE n WHEN 1 THEN replace(text, 'tion.', 'TION!') ELSE text END) AS BIGINT) AS byte_len FROM n")
def edit_count_status(spark, sf_dir):
    return ed.edit(corpus(spark, sf_dir), "tion.", "TION!").drop("text")


@query("edit_normalize", f"SELECT {PATH}, array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ' || chr(9))), chr(10)) AS text FROM documents")
def edit_normalize(spark, sf_dir):
    return ed.normalized(corpus(spark, sf_dir))


@query("edit_batch_status", f"""WITH n AS (SELECT {PATH}, text, string_split(text, chr(10))[1] AS f, doc_id FROM documents), c AS (SELECT *, CAST((len(text) - len(replace(text, f, ''))) / len(f) AS INTEGER) AS k FROM n WHERE len(trim(f)) > 0)
SELECT path, CASE WHEN k > 1 THEN 'multipleMatches' END AS error_kind, CASE WHEN k > 1 THEN NULL ELSE '<' || text[1:len(f)] || '>' || text[len(f) + 1:] END AS content FROM c WHERE NOT (len(f) > 1 AND strpos(text[2:], f) > 0 AND k = 1)""")
def edit_batch_status(spark, sf_dir):
    c = corpus(spark, sf_dir)
    first = F.split("text", "\n", -1)[0]
    edits = c.where(F.char_length(F.trim(first)) > 0).select("path", F.lit(0).alias("edit_index"), first.alias("old_text"), F.concat(F.lit("<"), first, F.lit(">")).alias("new_text"))
    return ed.edit_batch(c, edits, skip_diff=True).select("path", "error_kind", "content")


@query("diff_rows", f"WITH a AS (SELECT {PATH}, string_split(text, chr(10)) AS a, string_split(replace(text, 'disgusting', 'lovely'), chr(10)) AS b FROM documents), l AS (SELECT path, unnest(range(1, len(a) + 1)) AS line_number, unnest(a) AS old_text, unnest(b) AS new_text FROM a) SELECT path, line_number, old_text, new_text FROM l WHERE old_text <> new_text")
def diff_rows(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return ed.changed_lines(c, c.select("path", F.replace("text", F.lit("disgusting"), F.lit("lovely")).alias("text")))


@query("diff_hunks", f"WITH a AS (SELECT {PATH}, string_split(text, chr(10)) AS a, string_split(replace(text, 'pathetic', 'lovely'), chr(10)) AS b FROM documents), l AS (SELECT path, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS x, unnest(b) AS y FROM a), k AS (SELECT * FROM l WHERE x <> y) SELECT path, 'delete' AS op, CAST(n AS INTEGER) AS old_line, CAST(NULL AS INTEGER) AS new_line, x AS text FROM k UNION ALL SELECT path, 'insert', NULL, CAST(n AS INTEGER), y FROM k")
def diff_hunks(spark, sf_dir):
    c = corpus(spark, sf_dir)
    d = ed.diff(c, c.select("path", F.replace("text", F.lit("pathetic"), F.lit("lovely")).alias("text")), context=0)
    return d.select("path", "op", "old_line", "new_line", "text")
