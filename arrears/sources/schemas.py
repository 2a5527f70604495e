"""Explicit schemas; nothing is inferred."""

SOURCE_FILES = "repo_id string, path string, text string"
COMMIT_FILES = ("repo_id string, commit_seq long, commit_id string, author_email string, "
                "author_date timestamp, new_path string, old_path string, added_lines int")
SALARIES = "title string, companyName string, totalyearlycompensation double"
RULES = ("key string, severity string, type string, defaultRemFnBaseEffort string, "
         "defaultRemFn string")
SNIPPETS = "technology string, language string, rank int, body string, href string"
SCANNER_RESULTS = ("repo_id string, filename string, line_number int, issue_text string, "
                   "issue_severity string, issue_confidence string, test_id string, cwe_id string")
ADVISORIES = (
    "package string, version string, aliases array<string>, "
    "severity array<struct<type:string,score:string>>, "
    "affected array<struct<ranges:array<struct<events:array<"
    "struct<introduced:string,fixed:string>>>>>>")
REPOSITORY_PAYLOAD = (
    "id long, name string, full_name string, private boolean, html_url string, clone_url string, "
    "default_branch string, description string, language string, updated_at string, "
    "owner struct<login:string,avatar_url:string>")
SCANS = (
    "repo_id string, scan_id string, job_id string, user_id string, created_at timestamp, "
    "status string, total_cost_usd decimal(18,2), debt_score decimal(18,2), "
    "total_hours decimal(18,2), total_sprints decimal(18,2), hourly_rate decimal(18,2), "
    "rate_confidence string, team_size int, bus_factor int, repo_age_days int, "
    "combined_multiplier decimal(18,2), primary_language string, payload string")
SUPPRESSIONS = ("repo_id string, scan_id string, finding_key string, reason string, "
                "created_by string, active boolean, created_at timestamp")
FEEDBACK = ("repo_id string, scan_id string, finding_key string, feedback_type string, "
            "severity_override string, notes string, created_by string, created_at timestamp")
REMOVALS = "user_id string, repo_id string, removed_at timestamp"
REPOSITORIES = ("repo_id string, github_url string, repo_name string, repo_owner string, "
                "language string, last_scanned_at timestamp, user_id string")

#: Stored tables. ``seq`` rises in finding order within a scan.
STORE = {
    "scans": SCANS,
    "debt_items": (
        "repo_id string, scan_id string, step int, file string, category string, severity string, type string, "
        "function string, line int, remediation_hours decimal(18,6), cost_usd decimal(18,2), confidence decimal(18,2), "
        "business_impact string, complexity int, change_count long, detail string"),
    "findings": (
        "repo_id string, scan_id string, finding_key string, seq long, file_path string, module string, category string, "
        "subcategory string, symbol_name string, line_start int, line_end int, severity string, business_impact string, "
        "effort_hours decimal(18,2), cost_usd decimal(18,2), confidence decimal(18,2), source_tool string, status string, "
        "evidence array<struct<source:string,summary:string>>, owner_count long, top_contributor_share decimal(18,2), "
        "ownership_risk string"),
    "module_summaries": (
        "repo_id string, scan_id string, module string, finding_count long, total_cost_usd decimal(28,2), "
        "total_effort_hours decimal(28,2), max_severity string, avg_confidence decimal(18,2), owner_count long, "
        "top_contributor_share decimal(18,2), ownership_risk string"),
    "roadmap_items": (
        "repo_id string, scan_id string, bucket string, position long, finding_id string, title string, file_path string, "
        "module string, severity string, business_impact string, effort_hours decimal(18,2), cost_usd decimal(18,2), "
        "confidence decimal(18,2)"),
    "finding_rollups": (
        "repo_id string, scan_id string, category string, findings long, cost_usd decimal(28,2), open_findings long, "
        "open_cost_usd decimal(28,2)"),
    "repositories": REPOSITORIES,
    "suppressions": SUPPRESSIONS,
    "feedback": FEEDBACK,
    "removals": REMOVALS,
}
