"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import mixing, quality
from .queries import MIX_SHARE, MIX_WEIGHTS

_WORD = r"[^\x20\x09-\x0D]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(line: str, chars) -> str:
    out = line
    for c in chars:
        out = f"replace({out}, {_text(c)}, '')"
    return f"(length({line}) - length({out}))"


def _fails(x: str) -> str:
    phrases = " OR ".join(f"contains(lower({x}), {_text(p)})" for p in quality.BOILERPLATE)
    n_words = f"(length({x}) - length(replace({x}, ' ', '')) + 1)"
    shouts = _count(x, "!")
    return f"""(regexp_matches({x}, '{_WORD}') AND (
        NOT regexp_matches({x}, {_text(quality.PAUSE)})
        OR {_count(x, quality.SYMBOLS)} > 0.1::DOUBLE * length({x})
        OR ({shouts} > 2 AND {shouts} > 0.3::DOUBLE * {n_words})
        OR {_count(x, quality.SEPARATORS)} > 2
        OR {phrases}))"""


def op1_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws, string_split(text, chr(10)) AS ls,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS full_ls,
         list_filter(string_split(text, chr(10)), lambda x: NOT {_fails("x")}) AS pass_ls
  FROM d),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w),
grams AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS g FROM starts),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) t(k) GROUP BY rid),
c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         {_count("text", quality.SYMBOLS)}::BIGINT AS n_symbols,
         (len(full_ls) - len(list_distinct(full_ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(full_ls)::BIGINT AS n_lines,
         (len(ls) - len(pass_ls))::BIGINT AS n_failed_lines,
         length(array_to_string(ls, '')) AS total, length(array_to_string(pass_ls, '')) AS passed
  FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (total = 0 OR (total - passed)::DOUBLE / total <= 0.5) AS kept, n_lines, n_failed_lines
FROM f"""


def op2_sql(weights=MIX_WEIGHTS, share=MIX_SHARE, max_epochs=2, seed=42) -> str:
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(weights))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}+'))::BIGINT AS size,
         md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
g AS (SELECT source, key, doc_id, size, count(*) AS copies, size * count(*) AS group_size FROM d GROUP BY source, key, doc_id, size),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weight} END)::DOUBLE AS weight,
         (source_size * {max_epochs})::DOUBLE AS lim, (sum(source_size) OVER ())::DOUBLE * {share}::DOUBLE AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(lim, weight * max(level) OVER ()) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({max_epochs}, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, round(target)::BIGINT - epochs * source_size AS rest FROM e),
p AS (
  SELECT *, coalesce(sum(group_size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (r.epochs * d.size + CASE WHEN p.start + p.group_size <= r.rest THEN d.size WHEN p.start >= r.rest THEN 0
          ELSE (r.rest - p.start) // p.copies END)::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key
              AND d.doc_id IS NOT DISTINCT FROM p.doc_id AND d.size = p.size
       JOIN r ON d.source IS NOT DISTINCT FROM r.source"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1_sql(), "op2_mixing": op2_sql()}
