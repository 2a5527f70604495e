"""Rules on Python facts: complexity, documentation, reliability, performance, dead code, copies."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import paths
from arrears.functions.numeric import places
from arrears.functions.scoring import complexity_severity, confidence
from arrears.operators.facts import scanned
from arrears.operators.items import debt_items, hours_from_minutes


def measured_functions(facts: DataFrame) -> DataFrame:
    """Module functions and class methods with their cyclomatic complexity and severity."""
    return scanned(facts, "function").filter("n1 IS NOT NULL").select(
        "repo_id", "path", F.col("name").alias("function"), F.col("n1").alias("complexity"),
        complexity_severity(F.col("n1")).alias("severity"), F.lit("python").alias("language"),
        F.col("line").alias("line_number"),
        F.concat_ws(":", "path", "line").alias("full_name"))


def complexity_summary(functions: DataFrame) -> DataFrame:
    """Functions, mean complexity and the four severity counts per repository."""
    return functions.groupBy("repo_id").agg(
        F.count("*").alias("total_functions"),
        places(F.sum("complexity").cast("double") / F.count("*"), 2).alias("avg_complexity"),
        *[F.count_if(F.col("severity") == name).alias(f"{name}_functions")
          for name in C.SEVERITY_RANK])


def file_complexity(functions: DataFrame) -> DataFrame:
    return functions.groupBy("repo_id", "path").agg(F.max("complexity").alias("max_complexity"))


def high_risk_functions(functions: DataFrame) -> DataFrame:
    return functions.filter(F.col("severity").isin("high", "critical"))


def missing_docstrings(facts: DataFrame) -> DataFrame:
    """Undocumented functions (special methods aside) and classes."""
    special = F.col("name").startswith("__") & F.col("name").endswith("__")
    functions = scanned(facts, "function").filter(~F.col("flag") & ~special)
    classes = scanned(facts, "class").filter(~F.col("flag"))
    found = functions.withColumn("doc_type", F.lit("missing_docstring")).unionByName(
        classes.withColumn("doc_type", F.lit("missing_class_docstring")))
    return debt_items(found, "documentation", category="documentation", severity="low",
                      kind="missing_docstring", impact="low",
                      hours=hours_from_minutes(F.lit(C.RULE_SEVERITY_MINUTES["MINOR"])),
                      trust=confidence("documentation"), function=F.col("name"),
                      line=F.col("line"), doc_type=F.col("doc_type"))


def reliability_smells(facts: DataFrame) -> DataFrame:
    """Bare and broad handlers, silent handlers, mutable default arguments."""
    handlers = scanned(facts, "handler")
    name = F.col("name")
    loose = debt_items(
        handlers.filter(name.isin("bare", "Exception")), "reliability", category="reliability",
        severity=F.when(name == "bare", "high").otherwise("medium"),
        kind=F.when(name == "bare", "bare_except").otherwise("broad_exception"),
        hours=F.when(name == "bare", 2.0).otherwise(1.5), impact="medium",
        line=F.col("line"), detail=name)
    silent = debt_items(
        handlers.filter("flag"), "reliability", category="reliability", severity="high",
        kind="silent_exception_handler", hours=2.0, impact="high", line=F.col("line"))
    mutable = debt_items(
        scanned(facts, "function").filter("group_ord = 1"), "reliability", category="reliability",
        severity="medium", kind="mutable_default_argument", hours=1.25, impact="medium",
        function=name, line=F.col("line"))
    return loose.unionByName(silent).unionByName(mutable)


def performance_smells(facts: DataFrame) -> DataFrame:
    """Loop smells up to and including the first loop nested in each outer loop.

    A group is one loop of one file, so the window is bounded by the size of a source file.
    """
    loop = Window.partitionBy("repo_id", "path", "group_ord")
    first_nested = F.min(F.when(F.col("name") == "nested_loop", F.col("ord"))).over(loop)
    hits = (scanned(facts, "in_loop").withColumn("_stop", first_nested)
            .filter(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))))
    name = F.col("name")
    return debt_items(
        hits, "performance", category="performance", severity="medium", kind=name,
        hours=F.when(name == "nested_loop", 1.5)
        .when(name == "accumulation_in_loop", 1.25).otherwise(1.0),
        impact=F.when(name == "append_on_expression_in_loop", "low").otherwise("medium"),
        line=F.col("line"), detail=F.col("text"))


def dead_code(facts: DataFrame) -> DataFrame:
    """First statement after a jump in each body; private functions nothing in the file reads."""
    unreachable = (scanned(facts, "after_jump").groupBy("repo_id", "path", "group_ord")
                   .agg(F.min_by("line", "ord").alias("line")))
    loads = scanned(facts, "name_load").select("repo_id", "path", "name").distinct()
    unused = scanned(facts, "private_function").join(loads, ["repo_id", "path", "name"],
                                                     "left_anti")
    common = dict(category="code_quality", severity="low", impact="low")
    return debt_items(unreachable, "dead_code", kind="unreachable_code", hours=0.5,
                      line=F.col("line"), **common).unionByName(
        debt_items(unused, "dead_code", kind="unused_private_function", hours=0.75,
                   function=F.col("name"), line=F.col("line"), **common))


def duplicate_groups(fragments: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Fingerprints seen at least twice in at least two files, with copies and files.

    Counting by (fingerprint, file) first keeps a group with very many copies off a single task.
    """
    per_file = (fragments.groupBy("repo_id", fingerprint, "path")
                .agg(F.count("*").alias("copies")))
    return (per_file.groupBy("repo_id", fingerprint)
            .agg(F.sum("copies").alias("duplication_count"), F.count("*").alias("file_count"))
            .filter("duplication_count >= 2 AND file_count >= 2"))


def duplicate_occurrences(fragments: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Every copy with its group's counts, one row per occurrence.

    The list of files of a group is the group's rows themselves; repeating it on each row would be
    quadratic in the copies.
    """
    groups = duplicate_groups(fragments, fingerprint)
    return fragments.join(groups, ["repo_id", fingerprint])


def duplication_effort(copies):
    return F.least(F.lit(8.0), 1.5 + (copies - 2) * 1.25)


def duplicate_logic(facts: DataFrame) -> DataFrame:
    bodies = scanned(facts, "function").filter("n2 >= 2").select(
        "repo_id", "path", "name", "line", F.col("text").alias("fingerprint"))
    copies = F.col("duplication_count")
    return debt_items(duplicate_occurrences(bodies), "duplication", category="code_quality",
                      severity=F.when(copies >= 4, "high").otherwise("medium"),
                      kind="duplicate_logic", hours=duplication_effort(copies), impact="medium",
                      function=F.col("name"), line=F.col("line"), detail=F.col("fingerprint"))


def file_stats(facts: DataFrame) -> DataFrame:
    """Per-file figures of the generated-code heuristic: functions, docstring share, handlers."""
    functions = (facts.filter("kind = 'function'").groupBy("repo_id", "path")
                 .agg(F.count("*").alias("functions"), F.count_if("flag").alias("documented")))
    files = facts.filter("kind = 'file'").select("repo_id", "path", F.col("flag").alias("has_try"))
    return (files.join(functions, ["repo_id", "path"], "left").fillna(0)
            .withColumn("mostly_documented", F.col("documented") > F.col("functions") * 0.5))


def generated_code(commit_files: DataFrame, facts: DataFrame) -> DataFrame:
    """Python files with at least two of four signals of generated code.

    All figures of the text come from the facts; the text itself is not read again.
    """
    path = F.coalesce(F.nullif("new_path", F.lit("")), F.nullif("old_path", F.lit("")))
    changes = (commit_files.withColumn("path", path)
               .filter(F.col("path").endswith(".py") & ~paths.mentions_skip_name(F.col("path"))))
    # A later change on the same author date replaces an earlier one, as a keyed map would.
    per_date = changes.groupBy("repo_id", "path", "author_date").agg(
        F.count("*").alias("commits"), F.sum("added_lines").alias("added"),
        F.max_by("added_lines", "commit_seq").alias("last_added"))
    history = per_date.groupBy("repo_id", "path").agg(
        F.sum("commits").alias("commit_count"), F.sum("added").alias("lines_added"),
        F.count("author_date").alias("dates"), F.max("last_added").alias("largest"))
    names = facts.filter("kind = 'words'").select(
        "repo_id", "path", F.when(F.col("n1") > 0, F.col("n2") / F.col("n1")).alias("generic_share"))
    key = ["repo_id", "path"]
    joined = history.join(file_stats(facts), key, "left").join(names, key, "left")
    lines, functions = F.col("lines_added"), F.coalesce("functions", F.lit(0))
    signals = {
        "single_large_commit": (F.col("dates") == 1) & (F.col("largest") > 150),
        "no_docstrings": (lines > 100) & (functions > 5)
        & ~F.coalesce("mostly_documented", F.lit(True)),
        "generic_names": F.coalesce("generic_share", F.lit(0.0)) > 0.4,
        "no_error_handling": (lines > 300) & (functions > 0)
        & ~F.coalesce("has_try", F.lit(True)),
    }
    flagged = joined.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in signals.items()})
    total = sum((F.col(name).cast("int") for name in signals), F.lit(0))
    return (flagged.withColumn("probability", places(F.least(F.lit(1.0), total / 4), 2))
            .filter(F.col("probability") > C.GENERATED_PROBABILITY)
            .select(*key, "probability", "lines_added", *signals))


def generated_code_report(suspects: DataFrame) -> DataFrame:
    total = F.count("*")
    return suspects.groupBy("repo_id").agg(
        total.alias("total_suspected"), F.sum("lines_added").alias("total_suspected_lines"),
        F.when(total > 20, C.GENERATED_TEXTS["many"]).otherwise(C.GENERATED_TEXTS["some"])
        .alias("recommendation"))
