"""Rules on Python source. Each part gives one file, written from a template its number chooses.

The SQL check never parses: it states, per template, which findings a file of that kind has.
"""

from pyspark.sql import functions as F

from arrears.catalog.base import D, R, query
from arrears.catalog.scalars import PRICE_SQL
from arrears.operators import architecture, smells
from arrears.operators.facts import staged_facts
from arrears.operators.items import price_items
from arrears.sources.schemas import SOURCE_FILES

# '~' stands for a line break. p is the part number, s its size, k = s % 20.
_LOAD = ("'def load_' || p || '(path):~    \"\"\"Load.\"\"\"~    try:~        return open(path)~"
         "    except:~        pass~'")
_MERGE = ("'def merge(items=[], extra={}):~    try:~        return items~    except Exception:~"
          "        raise~    except ValueError:~        return extra~'")
_TOTAL = ("'def total(rows):~    \"\"\"Sum.\"\"\"~    out = 0~    for row in rows:~        out += row~"
          "        (out + row).append(row)~        for cell in row:~            out += cell~"
          "    return out~'")
_SCAN = ("'def scan(rows):~    \"\"\"Scan.\"\"\"~    while rows:~        (rows + rows).append(1)~"
         "        rows.append(2)~        rows += [3]~    return rows~'")
_DEAD = ("'def run():~    \"\"\"Run.\"\"\"~    return 1~    print(\"never\")~~~def _unused_' || p || "
         "'():~    \"\"\"Never called.\"\"\"~    raise ValueError()~    x = 1~~~def _used():~"
         "    \"\"\"Called.\"\"\"~    return 2~~~VALUE = _used()~'")
_WORK = "'def work_' || p || '(a, b):~    total = a + b~    return total * ' || (s % 3) || '~'"
_BOX = ("'class Box_' || p || ':~    def check(self, v):~' || "
        "repeat('        if v:~            v = 1~', CAST(s % 20 AS INT)) || '        return v~"
        "    def __repr__(self):~        return \"box\"~'")
_BROKEN = "'def broken_' || p || '(:~    pass~'"
_NEXT = "(CASE (p {div} 30) % 4 WHEN 2 THEN p - 60 WHEN 3 THEN p - 30 ELSE p + 30 END)"
_IMPORTS = ("'import os~from . import local~import app.t0.m_' || (p + 12) || '~import app.t8.m_' || "
            + _NEXT + " || '.helper~from app.t5 import thing~' || CASE WHEN p % 20 = 8 THEN "
            + " || ".join(f"'import app.t0.m_' || (p + {12 + 30 * k}) || '~'" for k in range(1, 12))
            + " ELSE '' END")
_FUNCTION = ("CASE WHEN s % 2 = 0 THEN '    \"\"\"Doc.\"\"\"~' ELSE '    x = 0~' END || "
             "repeat('    x = 1~', 34) || '    return x~'")
_BIG = (" || ".join(f"'def f{k}():~' || {_FUNCTION}" for k in range(8))
        + " || CASE WHEN s >= 25 THEN "
        + " || ".join(f"'def f{k}():~' || {_FUNCTION}" for k in range(8, 12)) + " ELSE '' END")
_TEXT = ("replace(CASE p % 10 " + " ".join(
    f"WHEN {n} THEN {body}" for n, body in enumerate(
        (_LOAD, _MERGE, _TOTAL, _SCAN, _DEAD, _WORK, _BOX, _BROKEN, _IMPORTS, _BIG)))
    + " END, '~', chr(10))")
SOURCE = f"""SELECT p, s, CASE WHEN p % 3 = 0 THEN 'hub' ELSE 'p' || (p {{div}} 100) END AS repo_id,
CASE WHEN p % 50 = 22 THEN 'vendor/' ELSE '' END || 'app/t' || (p % 10) || '/m_' || p ||
CASE WHEN p % 50 = 31 THEN '_pb2' ELSE '' END || '.py' AS path, p % 10 AS tpl, {_TEXT} AS text,
p % 50 <> 22 AS live, p % 50 NOT IN (22, 31) AS plain
FROM (SELECT p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part)"""
FILES = f"files AS ({SOURCE.replace('{div}', '//')})"


FILES_A_TASK = 20_000


def source_files(t):
    # The text is made from a few numbers per row: spread those before making it. The cores known when the plan is made say
    # little of the files, so that tasks are counted by these as well; a count reads no column.
    parts = t.read("part")
    slices = max(t.spark.sparkContext.defaultParallelism, -(-parts.count() // FILES_A_TASK))
    parts.repartition(slices, "p_partkey").createOrReplaceTempView("arrears_part")
    rows = t.spark.sql(SOURCE.replace("{div}", "div").replace("FROM part", "FROM arrears_part"))
    return rows.select(*[c.split()[0] for c in SOURCE_FILES.split(", ")])


def facts(t):
    return staged_facts(source_files(t))


def _items(df, *columns):
    return price_items(df).select("repo_id", "file", *columns)


BIG_N = "CASE WHEN s >= 25 THEN 12 ELSE 8 END"
MEASURED = f"""measured AS (
SELECT repo_id, path, 'load_' || p AS name, 2 AS complexity, 1 AS line FROM files WHERE plain AND tpl = 0
UNION ALL SELECT repo_id, path, 'merge', 3, 1 FROM files WHERE plain AND tpl = 1
UNION ALL SELECT repo_id, path, 'total', 3, 1 FROM files WHERE plain AND tpl = 2
UNION ALL SELECT repo_id, path, 'scan', 2, 1 FROM files WHERE plain AND tpl = 3
UNION ALL SELECT repo_id, path, unnest(['run', '_unused_' || p, '_used']), 1, unnest([1, 7, 13]) FROM
  files WHERE plain AND tpl = 4
UNION ALL SELECT repo_id, path, 'work_' || p, 1, 1 FROM files WHERE plain AND tpl = 5
UNION ALL SELECT repo_id, path, 'check', 1 + s % 20, 2 FROM files WHERE plain AND tpl = 6
UNION ALL SELECT repo_id, path, '__repr__', 1, 4 + 2 * (s % 20) FROM files WHERE plain AND tpl = 6
UNION ALL SELECT repo_id, path, 'f' || k, 1, 1 + 37 * k FROM files, range(12) r(k) WHERE plain AND
  tpl = 9 AND k < {BIG_N})"""


@query("ast1_complexity", "AST1 PRJ1 SRC2",
       f"""WITH {FILES}, {MEASURED} SELECT repo_id, path, name AS "function", complexity::INTEGER AS
           complexity, CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN
           complexity <= 15 THEN 'high' ELSE 'critical' END AS severity, line::INTEGER AS line_number
           FROM measured""")
def complexity(t):
    return smells.measured_functions(facts(t)).select(
        "repo_id", "path", "function", "complexity", "severity", "line_number")


@query("agg2_high_risk_functions", "AGG2 AST1",
       f"""WITH {FILES}, {MEASURED} SELECT repo_id, path, name AS "function", complexity::INTEGER AS
           complexity FROM measured WHERE complexity > 10""")
def high_risk(t):
    return smells.high_risk_functions(smells.measured_functions(facts(t))).select(
        "repo_id", "path", "function", "complexity")


DOCS = f"""docs AS (
SELECT repo_id, path, 'merge' AS name, 1 AS line, 'missing_docstring' AS doc_type FROM files WHERE plain
  AND tpl = 1
UNION ALL SELECT repo_id, path, 'work_' || p, 1, 'missing_docstring' FROM files WHERE plain AND tpl = 5
UNION ALL SELECT repo_id, path, 'check', 2, 'missing_docstring' FROM files WHERE plain AND tpl = 6
UNION ALL SELECT repo_id, path, 'Box_' || p, 1, 'missing_class_docstring' FROM files WHERE plain AND tpl = 6
UNION ALL SELECT repo_id, path, 'f' || k, 1 + 37 * k, 'missing_docstring' FROM files, range(12) r(k) WHERE
  plain AND tpl = 9 AND s % 2 = 1 AND k < {BIG_N})"""


@query("cmp5_missing_docstrings", "CMP5 AST2 AST3",
       f"""WITH {FILES}, {DOCS} SELECT repo_id, path AS file, name AS "function", line::INTEGER AS line,
           doc_type, {R('10 / 60.0::DOUBLE', 6)} AS remediation_hours,
           {PRICE_SQL(R('10 / 60.0::DOUBLE', 6), '55.10', "'low'", '0.65')} AS cost_usd FROM docs""")
def missing_docstrings(t):
    return _items(smells.missing_docstrings(facts(t)), "function", "line", "doc_type",
                  "remediation_hours", "cost_usd")


@query("ast7_reliability_smells", "AST7 AST8 AST9 SRT5",
       f"""WITH {FILES}, hits AS (
           SELECT repo_id, path, 'bare_except' AS type, 5 AS line, 'high' AS severity, 2.0 AS h, 'medium' AS
             i FROM files WHERE plain AND tpl = 0
           UNION ALL SELECT repo_id, path, 'silent_exception_handler', 5, 'high', 2.0, 'high' FROM files
             WHERE plain AND tpl = 0
           UNION ALL SELECT repo_id, path, 'broad_exception', 4, 'medium', 1.5, 'medium' FROM files WHERE
             plain AND tpl = 1
           UNION ALL SELECT repo_id, path, 'mutable_default_argument', 1, 'medium', 1.25, 'medium' FROM files
             WHERE plain AND tpl = 1)
           SELECT repo_id, path AS file, type, line::INTEGER AS line, severity,
           {PRICE_SQL('h', '84.55', 'i', '0.7')} AS cost_usd FROM hits""")
def reliability(t):
    return _items(smells.reliability_smells(facts(t)), "type", "line", "severity", "cost_usd")


@query("ast10_performance_smells", "AST10 AST11 AST12 WIN8",
       f"""WITH {FILES}, hits AS (
           SELECT repo_id, path, unnest(['accumulation_in_loop', 'nested_loop', 'accumulation_in_loop']) AS
             type, unnest([5, 7, 8]) AS line FROM files WHERE plain AND tpl = 2
           UNION ALL SELECT repo_id, path, unnest(['accumulation_in_loop', 'append_on_expression_in_loop']),
             unnest([6, 4]) FROM files WHERE plain AND tpl = 3)
           SELECT repo_id, path AS file, type, line::INTEGER AS line, CASE type WHEN 'nested_loop' THEN
           {PRICE_SQL('1.5', '84.55', "'medium'", '0.7')} WHEN 'accumulation_in_loop' THEN
           {PRICE_SQL('1.25', '84.55', "'medium'", '0.7')} ELSE {PRICE_SQL('1.0', '84.55', "'low'", '0.7')}
           END AS cost_usd FROM hits""")
def performance(t):
    return _items(smells.performance_smells(facts(t)), "type", "line", "cost_usd")


@query("ast13_dead_code", "AST13 AST14 WIN9 SET3",
       f"""WITH {FILES} SELECT repo_id, path AS file, unnest(['unreachable_code', 'unreachable_code',
           'unused_private_function']) AS type, unnest([4, 10, 7])::INTEGER AS line,
           unnest(['', '', '_unused_' || p]) AS "function" FROM files WHERE plain AND tpl = 4""")
def dead_code(t):
    return _items(smells.dead_code(facts(t)), "type", "line",
                  F.coalesce("function", F.lit("")).alias("function"))


BODIES = f"""bodies AS (
SELECT repo_id, path, 'load_' || p AS name, 1 AS line, 'load' AS body FROM files WHERE plain AND tpl = 0
UNION ALL SELECT repo_id, path, 'total', 1, 'total' FROM files WHERE plain AND tpl = 2
UNION ALL SELECT repo_id, path, 'scan', 1, 'scan' FROM files WHERE plain AND tpl = 3
UNION ALL SELECT repo_id, path, unnest(['run', '_unused_' || p, '_used']), unnest([1, 7, 13]),
  unnest(['run', 'unused', 'used']) FROM files WHERE plain AND tpl = 4
UNION ALL SELECT repo_id, path, 'work_' || p, 1, 'work' || (s % 3) FROM files WHERE plain AND tpl = 5
UNION ALL SELECT repo_id, path, 'check', 2, 'check' || (s % 20) FROM files WHERE plain AND tpl = 6 AND
  s % 20 > 0
UNION ALL SELECT repo_id, path, 'f' || k, 1 + 37 * k, 'big' || (s % 2) FROM files, range(12) r(k) WHERE
  plain AND tpl = 9 AND k < {BIG_N})"""


@query("ast6_duplicate_logic", "AST6 JON15 SET3",
       f"""WITH {FILES}, {BODIES}, g AS (SELECT repo_id, body, count(*) AS n FROM bodies GROUP BY ALL HAVING
           count(DISTINCT path) >= 2)
           SELECT repo_id, path AS file, name AS "function", line::INTEGER AS line, CASE WHEN n >= 4 THEN
           'high' ELSE 'medium' END AS severity, {D('least(8, 1.5 + (n - 2) * 1.25)')} AS
           remediation_hours FROM bodies JOIN g USING (repo_id, body)""")
def duplicate_logic(t):
    return _items(smells.duplicate_logic(facts(t)), "function", "line", "severity",
                  "remediation_hours")


@query("arr5_duplicate_groups", "ARR5 AST6",
       f"""WITH {FILES}, {BODIES}, g AS (SELECT repo_id, body, count(*) AS n, count(DISTINCT path) AS f FROM
           bodies GROUP BY ALL) SELECT repo_id, n AS duplication_count, f AS file_count, count(*) AS groups
           FROM g WHERE f >= 2 GROUP BY ALL""")
def duplicate_groups(t):
    bodies = facts(t).filter("kind = 'function' AND n2 >= 2").filter(
        ~F.col("path").endswith("_pb2.py")).withColumnRenamed("text", "fingerprint")
    return smells.duplicate_groups(bodies).groupBy(
        "repo_id", "duplication_count", "file_count").agg(F.count("*").alias("groups"))


@query("ast4_oversized_modules", "AST4 AST15",
       f"""WITH {FILES} SELECT repo_id, path AS file, 'app.t9.m_' || p AS module,
           {PRICE_SQL('8', '84.55::DOUBLE * 1.2::DOUBLE', "'high'", '0.7')} AS cost_usd FROM files
           WHERE live AND tpl = 9 AND s >= 25""")
def oversized(t):
    return _items(architecture.oversized_modules(facts(t)), F.col("detail").alias("module"), "cost_usd")


_NEXT_SQL = _NEXT.format(div="//")
EDGES = f"""mods AS (SELECT repo_id, p FROM files WHERE live), edges AS (SELECT DISTINCT e.repo_id, src, dst
FROM (SELECT repo_id, p AS src, unnest([p + 12, {_NEXT_SQL}] || CASE WHEN p % 20 = 8 THEN
[p + 12 + 30 * k for k in range(1, 12)] ELSE [] END) AS dst FROM files WHERE tpl = 8) e JOIN mods m ON
m.repo_id = e.repo_id AND m.p = e.dst)"""


def _edges(t):
    """Edges by file; the known modules are paths and need no parsing."""
    return architecture.local_imports(architecture.import_rows(facts(t)),
                                      architecture.known_modules(source_files(t)))


@query("jon6_local_imports", "JON6 AST15 STR2",
       f"""WITH {FILES}, {EDGES} SELECT repo_id, 'app.t8.m_' || src AS src, 'app.t' || (dst % 10) || '.m_' ||
           dst AS dst FROM edges""")
def local_imports(t):
    return _edges(t).select("repo_id", "src", "dst").distinct()


@query("ast5_high_fanout", "AST5",
       f"""WITH {FILES}, {EDGES} SELECT repo_id, 'app/t8/m_' || src || '.py' AS file, 'medium' AS severity
           FROM edges GROUP BY repo_id, src HAVING count(DISTINCT dst) >= 10""")
def high_fanout(t):
    return _items(architecture.high_fanout(_edges(t)), "severity")


@query("grf1_import_cycles", "GRF1",
       f"""WITH RECURSIVE {FILES}, {EDGES}, reach AS (SELECT repo_id, src, dst FROM edges WHERE dst % 10 = 8
           UNION SELECT r.repo_id, r.src, e.dst FROM reach r JOIN edges e ON e.repo_id = r.repo_id AND
           e.src = r.dst WHERE e.dst % 10 = 8)
           SELECT a.repo_id, min('app.t8.m_' || b.src) AS component, 'app.t8.m_' || a.src AS module
           FROM reach a JOIN reach b ON a.repo_id = b.repo_id AND a.src = b.dst AND a.dst = b.src
           GROUP BY a.repo_id, a.src""")
def import_cycles(t):
    return architecture.import_cycles(_edges(t))


@query("grf1_part_cycles", "GRF1",
       """WITH RECURSIVE edges AS (SELECT p_partkey // 12 AS g, 'n' || (p_partkey % 12) AS src, 'n' ||
          ((p_partkey * 7 + p_size) % 12) AS dst FROM part), reach AS (SELECT * FROM edges UNION SELECT
          r.g, r.src, e.dst FROM reach r JOIN edges e ON e.g = r.g AND e.src = r.dst)
          SELECT 'g' || a.g AS repo_id, min(b.src) AS component, a.src AS module FROM reach a JOIN reach b ON
          a.g = b.g AND a.src = b.dst AND a.dst = b.src GROUP BY a.g, a.src""")
def part_cycles(t):
    edges = t.read("part").selectExpr(
        "'g' || (p_partkey div 12) AS repo_id", "'n' || (p_partkey % 12) AS src",
        "'n' || ((p_partkey * 7 + p_size) % 12) AS dst")
    return architecture.import_cycles(edges)


# --- generated code -------------------------------------------------------------------------------

_CHANGES = """SELECT repo_id, path AS new_path, CAST(NULL AS {text}) AS old_path, p * 10 + k AS commit_seq,
CASE WHEN s % 2 = 0 THEN k ELSE 0 END AS day, CAST(s * 8 AS INT) AS added_lines FROM"""
CHANGES_SQL = f"changes AS ({_CHANGES.format(text='VARCHAR')} files, range(1, 4) r(k) WHERE k <= s % 3 + 1)"


def code_changes(t):
    t.read("part").createOrReplaceTempView("arrears_part")
    source = SOURCE.replace("{div}", "div").replace("FROM part", "FROM arrears_part")
    return t.spark.sql(f"""{_CHANGES.format(text='STRING')} (SELECT *, explode(sequence(1, CAST(s % 3 + 1
        AS INT))) AS k FROM ({source}))""").withColumn(
        "author_date", F.expr("timestampadd(DAY, day, TIMESTAMP '2020-01-01')")).drop("day")


_TOKENS = ("list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, "
           "'[A-Za-z_][A-Za-z0-9_]*'))")
_GENERIC = ("('data', 'result', 'response', 'output', 'temp', 'x', 'y', 'res', 'obj', 'val', 'item', "
            "'info', 'dict', 'list', 'arr', 'tmp')")
SUSPECTS = f"""{CHANGES_SQL}, hist AS (SELECT repo_id, new_path AS path, count(DISTINCT day) AS dates,
max(added_lines) AS largest, sum(added_lines) AS lines FROM changes WHERE new_path NOT LIKE '%vendor%' GROUP
BY ALL), signals AS (SELECT h.repo_id, h.path, lines, (dates = 1 AND largest > 150) AS single_large_commit,
(lines > 100 AND tpl = 9 AND s % 2 = 1) AS no_docstrings, len(list_filter(w, lambda x: x IN
{_GENERIC}))::DOUBLE / len(w) > 0.4 AS generic_names, (lines > 300 AND tpl NOT IN (0, 1, 7, 8)) AS
no_error_handling FROM hist h JOIN (SELECT *, {_TOKENS} AS w FROM files) USING (repo_id, path)),
suspects AS (SELECT *, (single_large_commit::INT + no_docstrings::INT + generic_names::INT +
no_error_handling::INT) / 4.0::DOUBLE AS probability FROM signals)"""


@query("cmp11_generated_code", "CMP11 AGG15 AGG29 PRJ22",
       f"""WITH {FILES}, {SUSPECTS} SELECT repo_id, path, {R('probability')} AS probability, lines::BIGINT AS
           lines_added, single_large_commit, no_docstrings, generic_names, no_error_handling FROM suspects
           WHERE probability > 0.3""")
def generated_code(t):
    return smells.generated_code(code_changes(t), facts(t))


@query("agg16_generated_report", "AGG16 SRT13",
       f"""WITH {FILES}, {SUSPECTS} SELECT repo_id, count(*) AS total_suspected, sum(lines)::BIGINT AS
           total_suspected_lines, CASE WHEN count(*) > 20 THEN 'High AI usage detected - consider code review'
           ELSE 'Review suspected files for quality issues' END AS recommendation FROM suspects WHERE
           probability > 0.3 GROUP BY repo_id""")
def generated_report(t):
    return smells.generated_code_report(generated_code(t))


@query("srt13_top_suspects", "SRT13",
       f"""WITH {FILES}, {SUSPECTS} SELECT repo_id, path, position FROM (SELECT *, row_number() OVER (PARTITION
           BY repo_id ORDER BY probability DESC, path) AS position FROM suspects WHERE probability > 0.3)
           WHERE position <= 50""")
def top_suspects(t):
    from arrears.operators.common import top_per_group

    return top_per_group(generated_code(t), ["repo_id"], [F.col("probability").desc(), F.col("path")], 50).select("repo_id", "path", "position")
