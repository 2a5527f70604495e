"""Registry of queries and the logical tables they read, derived from the given tables.

Every logical table exists twice: as a DataFrame (methods of ``Tables``) and as a common table
expression for the SQL check (``CTES``). Both cover all rows of the given tables.
"""

from dataclasses import dataclass
from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = "2001-06-01"


@dataclass
class Entry:
    run: Callable
    ids: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query under ``name`` for the inventory ids it covers."""
    def register(function):
        text = sql
        if text is not None and ctes:
            body = ",\n".join(f"{c} AS ({CTES[c]})" for c in ctes)
            stripped = text.lstrip()
            if stripped.upper().startswith("WITH RECURSIVE "):
                text = f"WITH RECURSIVE {body},\n{stripped[15:]}"
            elif stripped.upper().startswith("WITH "):
                text = f"WITH {body},\n{stripped[5:]}"
            else:
                text = f"WITH {body}\n{stripped}"
        ENTRIES[name] = Entry(function, tuple(ids.split()), text)
        return function
    return register


def publish(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare by value across engines."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
        else F.col(f.name) for f in df.schema.fields])


REPO_OF_COMMIT = "CASE WHEN o_custkey % 3 = 0 THEN 'hub' ELSE 'repo_' || (o_custkey {div} 50) END"
PATH_OF_KEY = ("CASE WHEN {k} % 31 = 0 THEN 'root_' || ({k}) || '.py' "
               "ELSE 'pkg_' || ({k} % 20) || '/mod_' || ({k}) || '.py' END")
CATEGORY_OF_PART = (
    "CASE l_partkey % 8 WHEN 0 THEN 'code_quality' WHEN 1 THEN 'architecture' "
    "WHEN 2 THEN 'security' WHEN 3 THEN 'documentation' WHEN 4 THEN 'dependency' "
    "WHEN 5 THEN 'test_debt' WHEN 6 THEN 'reliability' ELSE 'performance' END")
SEVERITY_OF_QUANTITY = (
    "CASE WHEN l_quantity <= 15 THEN 'low' WHEN l_quantity <= 30 THEN 'medium' "
    "WHEN l_quantity <= 42 THEN 'high' ELSE 'critical' END")
SEQ = "(CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 10000000 + l_suppkey"


def _commit_columns(div: str) -> list[str]:
    key = "CASE WHEN o_custkey % 3 = 0 THEN l_partkey ELSE l_partkey % 60 END"
    raw = (f"CASE WHEN l_partkey % 29 = 0 THEN 'vendor/mod_' || ({key}) || '.py' "
           f"ELSE (CASE WHEN l_partkey % 7 = 0 THEN './' ELSE '' END) || "
           + PATH_OF_KEY.format(k=f"({key})") + " END")
    return [
        REPO_OF_COMMIT.format(div=div) + " AS repo_id",
        "o_orderkey AS commit_seq", "'c' || o_orderkey AS commit_id",
        "CASE WHEN o_custkey % 41 = 0 THEN '' "
        f"WHEN o_custkey % 5 = 0 THEN ' Dev' || (o_custkey {div} 2) || '@X.org ' "
        f"ELSE 'dev' || (o_custkey {div} 2) || '@x.org' END AS author_email",
        "o_orderdate AS author_date",
        f"CASE WHEN l_linenumber = 7 OR l_partkey % 97 = 0 THEN NULL ELSE {raw} END AS new_path",
        f"CASE WHEN l_linenumber = 7 AND l_partkey % 97 <> 0 THEN {raw} END AS old_path",
        "CAST(l_quantity * 4 AS INT) AS added_lines",
    ]


def _function_columns() -> list[str]:
    key = "CASE WHEN p_partkey % 2 = 0 THEN p_partkey - p_partkey % 8 ELSE p_partkey % 60 END"
    return [
        "CASE WHEN p_partkey % 2 = 0 THEN 'hub' ELSE 'repo_' || (p_partkey % 20) END AS repo_id",
        PATH_OF_KEY.format(k=f"({key})") + " AS path",
        "'f' || p_partkey AS function", "p_size AS complexity",
        "CAST(p_partkey % 500 AS INT) AS line_number",
    ]


def _finding_columns() -> list[str]:
    return [
        "l_orderkey AS scan_id", "'f-' || (l_partkey % 25) AS finding_key",
        "'src/mod_' || (l_suppkey % 15) || '/file_' || l_partkey || '.py' AS file_path",
        "'src/mod_' || (l_suppkey % 15) AS module",
        CATEGORY_OF_PART + " AS category", SEVERITY_OF_QUANTITY + " AS severity",
        "CASE WHEN l_quantity <= 20 THEN 'medium' ELSE 'high' END AS business_impact",
        "CAST(l_quantity / 4 AS DECIMAL(18,2)) AS effort_hours",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS cost_usd",
        "CAST(1 - l_discount AS DECIMAL(18,2)) AS confidence",
        "'open' AS status",
        SEQ + " AS seq",
    ]


def _scan_columns() -> list[str]:
    dec = "CAST(ROUND(CAST({} AS DECIMAL(18,8)), 2) AS DECIMAL(18,2))"
    return [
        "CASE WHEN o_custkey % 3 = 0 THEN 'hub' ELSE 'r' || o_custkey END AS repo_id",
        "o_orderkey AS scan_id", "'job-' || o_orderkey AS job_id",
        "CAST(o_custkey % 10 AS BIGINT) AS user_id", "o_orderdate AS created_at",
        "CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'complete' END AS status",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS total_cost_usd",
        dec.format("least(10.0, o_totalprice / 50000)") + " AS debt_score",
        dec.format("o_totalprice / 100") + " AS total_hours",
        dec.format("o_totalprice / 8000") + " AS total_sprints",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'https://github.com/own' || (o_custkey % 7) || '/p' || "
        "(o_custkey % 50) || '/' ELSE '' END AS payload_url",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS primary_language",
    ]


def _repository_columns() -> list[str]:
    slug = "'org' || (c_custkey % 10) || '/repo' || c_custkey"
    return [
        "CASE WHEN c_custkey = 0 THEN 'hub' WHEN c_custkey % 3 = 0 THEN 'idle' || c_custkey "
        "ELSE 'r' || c_custkey END AS repo_id",
        f"CASE c_custkey % 6 WHEN 0 THEN 'https://github.com/' || {slug} "
        f"WHEN 1 THEN 'http://github.com/' || {slug} || '/' WHEN 2 THEN 'github.com/' || {slug} "
        f"WHEN 3 THEN {slug} WHEN 4 THEN 'https://gitlab.com/' || {slug} || '/' "
        f"ELSE '  https://github.com/' || {slug} || '//  ' END AS github_url",
        "c_name AS repo_name", "c_mktsegment AS language",
        "CAST(c_custkey % 10 AS BIGINT) AS user_id",
    ]


_SUPPRESSED = "event_type IN ('click', 'view')"
_EVENT_KEYS = ["event_id AS scan_id", "'f-' || (user_id % 25) AS finding_key"]
_SUPPRESSION = [*_EVENT_KEYS, "'reason ' || (user_id % 7) AS reason",
                "event_type = 'click' AS active", "ts AS created_at"]
_FEEDBACK = [*_EVENT_KEYS, "CASE event_type WHEN 'error' THEN 'false_positive' "
             "WHEN 'purchase' THEN 'accepted_risk' ELSE 'useful' END AS feedback_type",
             "ts AS created_at"]

_ITEM = [
    "CASE WHEN l_suppkey % 3 = 0 THEN 'hub' ELSE 'r' || (l_suppkey % 12) END AS repo_id",
    "CASE WHEN l_partkey % 13 = 0 THEN 'setup_' || l_partkey || '.py' ELSE "
    "'src/mod_' || (l_partkey % 15) || '/file_' || (l_partkey % 300) || '.py' END AS file",
    CATEGORY_OF_PART + " AS category", SEVERITY_OF_QUANTITY + " AS severity",
    "CASE WHEN l_partkey % 8 = 0 THEN 'complexity_hotspot' ELSE 'rule_' || (l_partkey % 8) END AS type",
    "CASE WHEN l_partkey % 3 = 0 THEN 'fn_' || l_suppkey END AS function",
    "CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey % 400 AS INT) END AS line",
    "CAST(l_quantity / 4 AS DECIMAL(18,6)) AS remediation_hours",
    "CAST(1 - l_discount * 5 AS DECIMAL(18,2)) AS confidence",
    "CASE WHEN l_quantity <= 20 THEN 'medium' ELSE 'high' END AS business_impact",
    "CASE WHEN l_partkey % 8 = 0 THEN CAST(l_quantity AS INT) END AS complexity",
    "CASE WHEN l_partkey % 8 = 0 THEN CAST(l_suppkey % 25 AS BIGINT) END AS change_count",
    "CASE WHEN l_partkey % 8 = 2 THEN 'Possible injection at ' || l_orderkey END AS issue_text",
    "CASE WHEN l_partkey % 8 = 3 THEN 'missing_docstring' END AS doc_type",
    "CASE WHEN l_partkey % 8 = 4 THEN 'pkg-' || (l_partkey % 50) END AS package",
    "l_partkey % 16 = 0 AS used_fallback",
    "CASE WHEN l_suppkey % 2 = 0 THEN CAST(1 + l_suppkey % 6 AS BIGINT) END AS owner_count",
    "CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_discount * 10 AS DECIMAL(18,2)) END AS top_contributor_share",
    "CASE WHEN l_suppkey % 2 = 0 THEN 'high' END AS ownership_risk",
    "CAST(l_extendedprice AS DECIMAL(18,2)) AS cost_usd",
    "CAST(1 + l_partkey % 8 AS INT) AS step", SEQ + " AS seq",
]


class Tables:
    """The given tables and the logical tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def commit_files(self) -> DataFrame:
        from arrears.operators.common import spread

        orders, lines = self.read("orders"), self.read("lineitem")
        return spread(orders, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
            *_commit_columns("div"))

    @cached_property
    def functions(self) -> DataFrame:
        from arrears.functions.scoring import complexity_severity

        return self.read("part").selectExpr(*_function_columns()).withColumn(
            "severity", complexity_severity(F.col("complexity")))

    @cached_property
    def scans(self) -> DataFrame:
        return self.read("orders").selectExpr(*_scan_columns())

    @cached_property
    def findings(self) -> DataFrame:
        return self.read("lineitem").selectExpr(*_finding_columns())

    @cached_property
    def repositories(self) -> DataFrame:
        return self.read("customer").selectExpr(*_repository_columns())

    @cached_property
    def suppressions(self) -> DataFrame:
        return self.read("events").filter(_SUPPRESSED).selectExpr(*_SUPPRESSION)

    @cached_property
    def feedback(self) -> DataFrame:
        return self.read("events").filter(f"NOT {_SUPPRESSED}").selectExpr(*_FEEDBACK)

    @cached_property
    def items(self) -> DataFrame:
        return self.read("lineitem").selectExpr(*_ITEM)


def _select(columns, source):
    return "SELECT " + ",\n  ".join(columns) + f"\nFROM {source}"


CTES = {
    "commit_files": _select(_commit_columns("//"),
                            "orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "functions": "SELECT *, CASE WHEN complexity BETWEEN 1 AND 5 THEN 'low' WHEN complexity BETWEEN "
                 "6 AND 10 THEN 'medium' WHEN complexity BETWEEN 11 AND 15 THEN 'high' ELSE "
                 "'critical' END AS severity FROM (" + _select(_function_columns(), "part") + ")",
    "scans": _select(_scan_columns(), "orders"),
    "findings": _select(_finding_columns(), "lineitem"),
    "repositories": _select(_repository_columns(), "customer"),
    "suppressions": _select(_SUPPRESSION, f"events WHERE {_SUPPRESSED}"),
    "feedback": _select(_FEEDBACK, f"events WHERE NOT {_SUPPRESSED}"),
    "items": _select(_ITEM, "lineitem"),
}


# --- snippets for the SQL check -------------------------------------------------------------------

def D(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def R(expression: str, digits: int = 2) -> str:
    """Rounded amount as double."""
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def RANK(column: str) -> str:
    return (f"(CASE lower({column}) WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 "
            f"WHEN 'critical' THEN 4 ELSE 0 END)")


def NAME(rank: str) -> str:
    return (f"(CASE {rank} WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' "
            f"ELSE 'low' END)")


def TITLE(column: str) -> str:
    """Title case of a label with underscores."""
    return (f"array_to_string(list_transform(string_split(replace({column}, '_', ' '), ' '), "
            f"lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")
