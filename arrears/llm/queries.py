"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm import (
    conversation_repair, curriculum, gru_lm, language, multi_index, near_embeddings, packing, partenum, periodic_runs, personal, rule_ensemble, sampling, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_embeddings(spark, sf_dir):
    return near_embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_sampled_segmentations(spark, sf_dir):
    return sampling.encode(_table(spark, sf_dir, "documents"), checked=True).withColumn("n_pieces", F.size("ids"))


def op3_toxicity(spark, sf_dir):
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_source_mixing(spark, sf_dir):
    return curriculum.report(_table(spark, sf_dir, "documents"))


def op5_ngram_join(spark, sf_dir):
    return partenum.similarity_classes(_table(spark, sf_dir, "documents"))


def op6_multi_index(spark, sf_dir):
    return multi_index.nearest(_table(spark, sf_dir, "embeddings"))


def op7_language(spark, sf_dir):
    return language.report(_table(spark, sf_dir, "documents"))


def op8_gru_scores(spark, sf_dir):
    return gru_lm.report(_table(spark, sf_dir, "documents"))


def op9_personal_data(spark, sf_dir):
    return personal.report(_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.report(_table(spark, sf_dir, "documents"))


def op11_rule_ensemble(spark, sf_dir):
    return rule_ensemble.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.report(_table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_near_embeddings, op2_sampled_segmentations, op3_toxicity, op4_source_mixing, op5_ngram_join, op6_multi_index, op7_language,
    op8_gru_scores, op9_personal_data, op10_packing, op11_rule_ensemble, op12_conversation_repair, op13_periodic_runs)}
_REACH = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT a, y FROM reach JOIN links ON x = b)"""
#: crc32 of an ASCII text, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({key}, ''), lambda c: unicode(c)::BIGINT),
  lambda r, b: list_reduce([xor(r, b)] || range(8), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

#: By the definitions (links of all pairs and what is reachable over them, all edits of each row, all equal triples of words).
ORACLE_SQL: dict[str, str] = {
    "op1_near_embeddings": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
usable AS (SELECT * FROM nodes WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND
  len(list_filter(v, lambda c: c <> 0)) > 0),
links AS (SELECT p.id AS x, q.id AS y FROM usable p JOIN usable q ON p.id <> q.id AND len(p.v) = len(q.v) WHERE
  list_cosine_similarity(p.v, q.v) >= 0.95), {_REACH},
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT a AS vec_id, coalesce(any_value(n), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reach LEFT JOIN counts
  ON x = a GROUP BY a""",
    "op5_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]
  END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS x, q.doc_id AS y, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes m ON m.doc_id = x JOIN sizes o ON o.doc_id = y WHERE 100 * k >= 90 * (m.n + o.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN sizes ON doc_id = a
  GROUP BY a""",
    "op12_conversation_repair": f"""WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
  rtrim(text, E' \\t\\n\\x0b\\x0c\\r') AS trimmed FROM damaged),
facts AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS initial, CASE WHEN trimmed = '' THEN 'blank' WHEN seen THEN 'duplicate'
  WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM facts GROUP BY conv_id),
inserts(state, stands, price, letters, said) AS (VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []),
  (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
keeps(stands, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (SELECT conv_id, i, state, stands AS after, price + 3 AS price, letters || 'D' AS letters, said FROM facts, inserts
  UNION ALL SELECT conv_id, i, state, after, price + if(fault = '', 0, 1), letters || 'K', list_append(said, role || ':' || text)
  FROM facts JOIN keeps USING (initial) JOIN inserts USING (stands) WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, i, state, if(stands = 2, 3, 2), price + if(fault = '', 2, 3), letters || 'R',
  list_append(said, if(stands = 2, 'assistant:', 'user:') || text) FROM facts, inserts WHERE fault IN ('', 'truncated')),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'audit': '', 'said': []::VARCHAR[]}} AS best FROM counts
  UNION ALL SELECT w.conv_id, w.i + 1, e.after, min({{'cost': w.best.cost + e.price, 'audit': w.best.audit || e.letters, 'said': w.best.said || e.said}})
  FROM walk w JOIN edits e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 AND e.state = w.state GROUP BY ALL),
ends AS (SELECT c.conv_id, min({{'cost': best.cost + price, 'audit': best.audit || letters, 'said': best.said || t.said}}) AS best FROM counts c
  JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN inserts t ON t.state = w.state
  WHERE t.stands IN (0, 3) GROUP BY c.conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.said, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) k
  LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM k.conv_id""",
    "op13_periodic_runs": f"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
  {_CRC.format(key="coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
numbered AS (SELECT *, row_number() OVER () AS row, len(ws) AS n, h // 10 AS g FROM split),
tails AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM numbered),
texts AS (SELECT doc_id, row, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: ws[1 + if(i < a, i, a + (i - a) % p)]) ELSE ws END AS ws FROM tails),
words AS (SELECT row, unnest(range(n)) AS i, unnest(ws) AS w FROM texts),
grams AS (SELECT row, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS gram FROM words WINDOW o AS (PARTITION BY row ORDER BY i)),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND y.i > x.i),
islands AS (SELECT row, q, min(i) AS start, max(i) - min(i) + 3 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island
  FROM pairs) GROUP BY row, q, island),
runs AS (SELECT row, start, length, min(q) AS period FROM islands GROUP BY row, start, length HAVING length >= greatest(6, 4 * min(q))),
listed AS (SELECT row, count(*) AS n_runs, min({{'l': -length, 's': start, 'p': period}}) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS told FROM runs GROUP BY row),
gone AS (SELECT DISTINCT w.row, w.i FROM words w JOIN runs r ON r.row = w.row AND w.i >= r.start + r.period AND w.i < r.start + r.length),
kept AS (SELECT w.row, string_agg(w, ' ' ORDER BY i) AS text FROM words w ANTI JOIN gone USING (row, i) GROUP BY w.row)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.p AS period, -best.l * 1000 // best.p AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed l USING (row) LEFT JOIN kept k USING (row)""",
}
