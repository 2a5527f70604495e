"""Repository profile: stack, team, rates, generated code and multipliers in one row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.operators import dependencies, history, rates, smells


def profile(source_files: DataFrame, commit_files: DataFrame, facts: DataFrame,
            blended: DataFrame, as_of) -> DataFrame:
    """``blended``: technology, mid_rate, junior_rate."""
    stack = dependencies.tech_stack(source_files)
    team = history.with_multipliers(history.default_team(
        stack, history.team_profile(commit_files, as_of)))
    suspects = smells.generated_code_report(
        smells.generated_code(commit_files, facts))
    stack_rates = rates.stack_rates(stack, blended)
    return (stack.join(team, "repo_id").join(stack_rates, "repo_id", "left")
            .join(suspects, "repo_id", "left")
            .fillna({"total_suspected": 0, "total_suspected_lines": 0,
                     "recommendation": C.GENERATED_TEXTS["none"]})
            .withColumn("uses_ai", F.size("ai_ml") > 0))
