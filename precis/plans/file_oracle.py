"""DuckDB SQL of the file queries: what the files hold, said from the tables."""

from __future__ import annotations

from precis.plans import params as P
from precis.plans.oracle import PAIRS, bootstrap_poisson_ctes, rouge_n_ctes


def file_sql() -> dict[str, str]:
    n = P.FILE_ROWS
    breaks = "\\r|\\x0b|\\x0c|\\x1c|\\x1d|\\x1e|\\x{85}|\\x{2028}|\\x{2029}"
    first, second, third = P.SPLIT_RATIO
    whole = first + second + third
    one_line = lambda c: f"regexp_replace({c}, '\\r\\n|\\r|\\n', ' ', 'g')"
    aligned = f"""{PAIRS},
aligned AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, {one_line('target')} AS article, {one_line('prediction')} AS summary,
            count(*) OVER () AS n FROM pairs)"""
    parts = f"""split AS (SELECT *, CASE WHEN id < (CAST({first} AS DOUBLE) / {whole}) * n THEN 'train'
    WHEN id < (CAST({first} AS DOUBLE) / {whole}) * n + (CAST({second} AS DOUBLE) / {whole}) * n THEN 'val' ELSE 'test' END AS split FROM aligned)"""
    bodies = f"files AS (SELECT doc_id // {n} AS file, string_agg(%s, '' ORDER BY doc_id) AS body FROM documents GROUP BY 1)"
    lines = "lines AS (SELECT file, string_split(body, chr(10))[:-2] AS arr FROM files)"
    return {
        "delimited_records": f"""
WITH {bodies % "text || chr(10) || chr(10)"},
cut AS (SELECT file, string_split(body, chr(10) || chr(10)) AS arr FROM files),
whole AS (SELECT file, CASE WHEN arr[-1] = '' THEN arr[:-2] ELSE arr END AS arr FROM cut)
SELECT file, generate_subscripts(arr, 1) - 1 AS line, unnest(arr) AS value FROM whole""",
        "item_stories": """
SELECT row_number() OVER (ORDER BY CAST(item_id AS VARCHAR) || '/') - 1 AS id, item_id, text || chr(10) AS content FROM benchmark""",
        "item_documents": "SELECT item_id, text || chr(10) AS text FROM benchmark",
        "json_records": f"""
SELECT row_number() OVER (ORDER BY CAST(page_id // {n} AS VARCHAR) || '/', page_id) - 1 AS id, url AS title, html AS text FROM pages""",
        "file_lines": f"""
WITH {bodies % "replace(text, 'e ', 'e' || chr(11)) || chr(10)"}, {lines},
raw AS (SELECT file, generate_subscripts(arr, 1) - 1 AS line, unnest(arr) AS value FROM lines),
cut AS (SELECT file, line, regexp_split_to_array(value, '{breaks}') AS arr FROM raw WHERE line >= 1),
whole AS (SELECT file, line, CASE WHEN len(arr) > 1 AND arr[-1] = '' THEN arr[:-2] ELSE arr END AS arr FROM cut)
SELECT file, line, generate_subscripts(arr, 1) - 1 AS sub, unnest(arr) AS value FROM whole""",
        "line_count": f"WITH {bodies % 'text || chr(10)'}, {lines} SELECT CAST(sum(len(arr)) AS BIGINT) AS n_lines FROM lines",
        "line_job": f"""
WITH {bodies % 'text || chr(10)'}, {lines},
raw AS (SELECT file, generate_subscripts(arr, 1) AS i, unnest(arr) AS value FROM lines)
SELECT row_number() OVER (ORDER BY CAST(file AS VARCHAR) || '/', i) - 1 AS id, replace(value, 'a', 'A') || '!' AS value
FROM raw WHERE i > 1 AND value <> ''""",
        "pairs_round_trip": f"WITH {aligned} SELECT id, article, summary FROM aligned",
        "split_round_trip": f"WITH {aligned}, {parts} SELECT id, split, article, summary FROM split",
        "split_text_round_trip": f"""
WITH {aligned}, {parts} SELECT row_number() OVER (ORDER BY id) - 1 AS id, article, summary FROM split WHERE split = 'test'""",
        "sample_round_trip": f"""
WITH {aligned}, kept AS (SELECT *, strlen(article) + 1 < {P.SAMPLE_BYTES} AS keep FROM aligned)
SELECT id, article, summary, (SELECT round(sum(keep::INT) / count(*) * 100, 2) FROM kept) AS share FROM kept WHERE keep""",
        "score_files": f"""
WITH {rouge_n_ctes([1, 2])},
ranked AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY id) - 1 AS id) FROM scores),
{bootstrap_poisson_ctes(P.BOOT_SAMPLES, P.BOOT_SEED).replace("FROM scores", "FROM ranked")},
long AS (UNPIVOT (SELECT * EXCLUDE b FROM means) ON precision, recall, fmeasure INTO NAME measure VALUE m),
qq AS (SELECT score_type, measure, quantile_cont(m, [{(1 - P.BOOT_CONFIDENCE) / 2!r}, 0.5, {1 - (1 - P.BOOT_CONFIDENCE) / 2!r}]) AS q
       FROM long GROUP BY score_type, measure)
SELECT score_type || '-' || CASE measure WHEN 'recall' THEN 'R' WHEN 'precision' THEN 'P' ELSE 'F' END AS score_type,
       round(q[1], 6) AS low, round(q[2], 6) AS mid, round(q[3], 6) AS high FROM qq""",
    }
