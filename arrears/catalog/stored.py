"""Questions over stored scans: triage, comparison, trends, portfolio, findings and roadmap."""

import uuid

from pyspark.sql import functions as F

from arrears import constants as C
from arrears.catalog.base import CATEGORY_OF_PART, D, NAME, R, RANK, TITLE, query
from arrears.operators import findings as fops
from arrears.operators import store
from arrears.operators.common import stage, top_per_group

ORDER = f"{RANK('severity')} DESC, cost_usd DESC, confidence DESC"
RECENT = """recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY
created_at DESC, scan_id DESC) AS position FROM scans WHERE status = 'complete') WHERE position <= {n})"""
PAIRS = f"""{RECENT.format(n=2)}, pairs AS (SELECT repo_id,
max(scan_id) FILTER (position = 1) AS latest_scan_id, max(scan_id) FILTER (position = 2) AS
previous_scan_id, max(total_cost_usd) FILTER (position = 1) AS latest_cost,
max(total_cost_usd) FILTER (position = 2) AS previous_cost, max(debt_score) FILTER (position = 1) AS
latest_score, max(debt_score) FILTER (position = 2) AS previous_score, max(total_hours) FILTER
(position = 1) AS latest_hours, max(total_hours) FILTER (position = 2) AS previous_hours
FROM recent GROUP BY repo_id)"""
SINGLE = """(SELECT * FROM (SELECT repo_id, f.*, row_number() OVER (PARTITION BY repo_id, finding_key
ORDER BY seq DESC) AS dup FROM findings f JOIN pairs ON scan_id = {side}_scan_id) WHERE dup = 1)"""
CHANGES = f"""{PAIRS}, changes AS (SELECT coalesce(l.repo_id, p.repo_id) AS repo_id,
coalesce(l.finding_key, p.finding_key) AS finding_key, CASE WHEN p.seq IS NULL THEN 'added' WHEN l.seq
IS NULL THEN 'removed' ELSE 'common' END AS change, l.severity AS to_severity, p.severity AS
from_severity, coalesce(l.cost_usd, p.cost_usd) AS cost, coalesce(l.category, p.category) AS category,
coalesce(l.seq, p.seq) AS seq, coalesce(l.file_path, p.file_path) AS file_path
FROM {SINGLE.format(side='latest')} l FULL JOIN {SINGLE.format(side='previous')} p
ON l.repo_id = p.repo_id AND l.finding_key = p.finding_key)"""
MARKS = """marks AS (SELECT scan_id, finding_key, arg_max(mark, created_at) AS mark FROM (SELECT scan_id,
finding_key, created_at, 'suppressed' AS mark FROM suppressions UNION ALL SELECT scan_id, finding_key,
created_at, 'reviewed' FROM feedback WHERE feedback_type IN ('false_positive', 'accepted_risk'))
GROUP BY ALL)"""
TRIAGED = f"""{MARKS}, triaged AS (SELECT f.* REPLACE (coalesce(m.mark, f.status) AS status), coalesce(s.suppressed, false) AS suppressed,
coalesce(s.n, 0) AS suppression_count, coalesce(b.n, 0) AS feedback_count,
coalesce(b.last_feedback, '') AS last_feedback FROM findings f LEFT JOIN (SELECT scan_id, finding_key,
bool_or(active) AS suppressed, count(*) AS n FROM suppressions GROUP BY ALL) s USING (scan_id,
finding_key) LEFT JOIN (SELECT scan_id, finding_key, count(*) AS n, arg_max(feedback_type, created_at)
AS last_feedback FROM feedback GROUP BY ALL) b USING (scan_id, finding_key) LEFT JOIN marks m USING (scan_id,
finding_key))"""
MODULES = f"""modules AS (SELECT scan_id, module, count(*) AS finding_count, sum(cost_usd) AS
total_cost_usd, {NAME(f'max({RANK("severity")})')} AS max_severity FROM findings GROUP BY scan_id,
module)"""
BUCKET = f"""CASE WHEN effort_hours <= 4 AND confidence >= 0.6 AND {RANK('severity')} >= 2 THEN
'quick_wins' WHEN effort_hours >= 8 OR {RANK('severity')} >= 4 THEN 'strategic' ELSE 'next_up' END"""
ROADMAP = f"""roadmap AS (SELECT *, row_number() OVER (PARTITION BY scan_id, bucket ORDER BY {ORDER}, seq) AS
position FROM (SELECT *, {BUCKET} AS bucket FROM findings))"""
T3 = ("findings", "suppressions", "feedback")


def triaged(t, scans=None):
    """Findings with triage; with ``scans``, only theirs, picked before events are counted."""
    parts = (t.findings, t.suppressions, t.feedback)
    return store.with_triage(*(parts if scans is None else [store.of_scans(p, scans) for p in parts]))


def modules(t, scans=None):
    findings = t.findings if scans is None else store.of_scans(t.findings, scans)
    return fops.summarize_modules(findings, ("scan_id",))


def roadmap(t, limit=None):
    found = t.findings.withColumn("id", F.col("finding_key"))
    return fops.roadmap(found, ("scan_id",), limit=limit, ties=("seq",))


@query("win2_latest_scans", "WIN2 SRC9 FLT7",
       f"WITH {RECENT.format(n=1)} SELECT repo_id, scan_id, {D('total_cost_usd')} AS total_cost_usd "
       "FROM recent", ("scans",))
def latest_scans(t):
    return store.latest_scans(t.scans).select("repo_id", "scan_id", "total_cost_usd")


@query("win2_latest_scans_of_user", "FLT7",
       f"""WITH mine AS (SELECT * FROM scans WHERE user_id = 3),
           {RECENT.format(n=1).replace('FROM scans', 'FROM mine')}
           SELECT repo_id, scan_id, job_id, user_id FROM recent""", ("scans",))
def latest_of_user(t):
    return store.latest_scans(t.scans, 3).select("repo_id", "scan_id", "job_id", "user_id")


@query("win4_history", "WIN4 QRY7 DTE2",
       f"""WITH {RECENT.format(n=20)} SELECT repo_id, scan_id, strftime(created_at,
           '%Y-%m-%dT%H:%M:%S') AS date, strftime(created_at, '%b %d') AS date_display,
           {D('total_cost_usd')} AS total_cost_usd, {D('debt_score')} AS debt_score, -position AS
           sort_key FROM recent""", ("scans",))
def history_points(t):
    return store.trend_points(store.history(t.scans, 20))


@query("win5_debt_trend", "WIN5 QRY7",
       f"""WITH {RECENT.format(n=20)}, ends AS (SELECT repo_id, count(*) AS total_scans,
           max(total_cost_usd::DOUBLE) FILTER (position = 1) AS latest_cost,
           max(total_cost_usd::DOUBLE) FILTER (position = 2) AS previous_cost,
           arg_max(total_cost_usd::DOUBLE, position) AS first_scan_cost FROM recent GROUP BY repo_id),
           pct AS (SELECT *, CASE WHEN total_scans < 2 OR previous_cost = 0 THEN 0 ELSE
           (latest_cost - previous_cost) / previous_cost * 100 END AS p FROM ends)
           SELECT repo_id, {R('p', 1)} AS change_pct, CASE WHEN p > 2 THEN 'up' WHEN p < -2 THEN
           'down' ELSE 'stable' END AS direction, total_scans, first_scan_cost, latest_cost
           FROM pct""", ("scans",))
def debt_trend(t):
    return store.debt_trend(t.scans)


@query("jon7_findings_with_triage", "JON7 FLT5",
       f"""WITH {TRIAGED} SELECT scan_id, seq, suppressed, suppression_count, feedback_count,
           last_feedback, status = 'open' AND NOT suppressed AS unresolved FROM triaged""", T3)
def findings_with_triage(t):
    return triaged(t).select(
        "scan_id", "seq", "suppressed", "suppression_count", "feedback_count",
        F.coalesce("last_feedback", F.lit("")).alias("last_feedback"),
        store.unresolved().alias("unresolved"))


@query("dml2_derived_status", "DML2 DML3",
       f"""WITH {MARKS} SELECT scan_id, seq, coalesce(mark, status) AS status FROM findings LEFT JOIN marks
          USING (scan_id, finding_key)""", T3)
def derived_status(t):
    return store.derived_status(t.findings, t.suppressions, t.feedback).select(
        "scan_id", "seq", "status")


@query("dml5_finding_lookup", "DML5",
       "SELECT scan_id, finding_key, severity, seq FROM findings WHERE finding_key = 'f-7'", ("findings",))
def finding_lookup(t):
    return t.findings.filter(F.col("finding_key") == "f-7").select("scan_id", "finding_key", "severity", "seq")


@query("flt4_query_findings", "FLT4 QRY3 SRT1",
       f"""SELECT category, severity, {D('cost_usd')} AS cost_usd, {D('confidence')} AS confidence,
           count(*) AS findings FROM findings WHERE category = 'security' AND severity IN ('high',
           'critical') AND confidence >= 0.95 GROUP BY ALL""", ("findings",))
def query_findings(t):
    kept = store.query_findings(t.findings, category="security", severity="high",
                                min_confidence=0.95)
    return kept.groupBy("category", "severity", "cost_usd", "confidence").agg(
        F.count("*").alias("findings"))


@query("srt12_findings_page", "SRT12 SRT1 FLT4",
       f"""SELECT scan_id, seq, severity, {D('cost_usd')} AS cost_usd FROM findings WHERE category =
           'dependency' ORDER BY {ORDER}, scan_id, seq LIMIT 50 OFFSET 100""", ("findings",))
def findings_page(t):
    kept = store.query_findings(t.findings, category="dependency")
    return store.page(kept, fops.finding_order("scan_id", "seq"), 50, 100).select(
        "scan_id", "seq", "severity", "cost_usd")


@query("srt12_next_page", "SRT12 QRY3",
       f"""SELECT scan_id, seq, severity, {D('cost_usd')} AS cost_usd FROM findings WHERE scan_id = (SELECT max(scan_id) FROM (SELECT
           scan_id FROM findings GROUP BY scan_id HAVING count(*) >= 4)) ORDER BY seq LIMIT 3 OFFSET 2""", ("findings",))
def next_page(t):
    """The second page of a scan, by the last ``seq`` of the first."""
    scan = t.findings.groupBy("scan_id").count().filter("count >= 4").agg(F.max("scan_id")).first()[0]
    seen = store.next_page(t.findings, scan, limit=2).agg(F.max("seq")).first()[0]
    return store.next_page(t.findings, scan, seen, 3).select("scan_id", "seq", "severity", "cost_usd")


@query("agg17_triage_stats", "AGG17 QRY11",
       f"""WITH {TRIAGED}, {RECENT.format(n=1)}, stats AS (SELECT repo_id, count(*) AS total_findings,
           count(*) FILTER (t.status = 'open') AS active_findings, count(*) FILTER (suppressed) AS
           suppressed_findings, count(*) FILTER (t.status = 'reviewed') AS reviewed_findings
           FROM triaged t JOIN recent USING (scan_id) GROUP BY repo_id)
           SELECT *, {R('suppressed_findings::DOUBLE / total_findings * 100', 1)} AS suppression_rate,
           {R('reviewed_findings::DOUBLE / total_findings * 100', 1)} AS review_rate FROM stats""",
       (*T3, "scans"))
def triage_stats(t):
    latest = store.latest_scans(t.scans).select("repo_id", "scan_id")
    return store.triage_stats(triaged(t, latest).join(latest, "scan_id"), ["repo_id"])


@query("agg17_category_counts", "AGG17 QRY11",
       f"""WITH {RECENT.format(n=1)} SELECT repo_id, category, count(*) AS findings FROM findings
           JOIN recent USING (scan_id) GROUP BY ALL""", ("findings", "scans"))
def category_counts(t):
    latest = store.latest_scans(t.scans).select("repo_id", "scan_id")
    return store.category_counts(t.findings.join(latest, "scan_id"), ["repo_id"])


@query("qry12_unresolved", "QRY12 FLT5 SRT1 SRT11",
       f"""WITH {TRIAGED}, {RECENT.format(n=1)} SELECT repo_id, position, seq, severity FROM (SELECT
           r.repo_id, t.seq, severity, row_number() OVER (PARTITION BY r.repo_id ORDER BY {ORDER},
           seq) AS position FROM triaged t JOIN recent r USING (scan_id) WHERE t.status = 'open' AND
           NOT suppressed) WHERE position <= 20""", (*T3, "scans"))
def unresolved(t):
    latest = store.latest_scans(t.scans).select("repo_id", "scan_id")
    return store.top_unresolved(triaged(t, latest).join(latest, "scan_id"), ["repo_id"]).select("repo_id", "position", "seq", "severity")


@query("jon7_triage_rows", "JON7",
       """SELECT f.scan_id, f.seq, e.kind, e.detail, strftime(e.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM
          findings f JOIN (SELECT scan_id, finding_key, 'suppression' AS kind, reason AS detail, created_at FROM
          suppressions UNION ALL SELECT scan_id, finding_key, 'feedback', feedback_type, created_at FROM feedback)
          e USING (scan_id, finding_key)""", T3)
def triage_rows(t):
    return store.triage_rows(t.findings, t.suppressions, t.feedback).select(
        "scan_id", "seq", "kind", "detail", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


# --- one scan -------------------------------------------------------------------------------------

ONE = 7  # the scan asked for


@query("qry1_scan_by_id", "QRY1",
       f"SELECT scan_id, repo_id, job_id, status, {D('total_cost_usd')} AS total_cost_usd FROM scans WHERE scan_id = {ONE}",
       ("scans",))
def scan_by_id(t):
    return store.scan_by_id(t.scans, ONE).select("scan_id", "repo_id", "job_id", "status", "total_cost_usd")


@query("qry17_scan_by_job", "QRY17",
       f"SELECT scan_id, repo_id, job_id, status FROM scans WHERE job_id = 'job-{ONE}'", ("scans",))
def scan_by_job(t):
    return store.scan_by_job(t.scans, f"job-{ONE}").select("scan_id", "repo_id", "job_id", "status")


@query("qry3_scan_findings", "QRY3 FLT4 SRT1 SRT12",
       f"""WITH {TRIAGED} SELECT scan_id, seq, severity, status, suppressed, {D('cost_usd')} AS cost_usd FROM triaged
           WHERE scan_id = {ONE} AND lower(severity) IN ('medium', 'high', 'critical') ORDER BY {ORDER}, seq LIMIT
           50""", T3)
def scan_findings(t):
    one = store.scan_by_id(t.scans, ONE)
    kept = store.query_findings(triaged(t, one), severity="medium")
    return store.page(kept, fops.finding_order("seq"), 50).select(
        "scan_id", "seq", "severity", "status", "suppressed", "cost_usd")


@query("qry4_scan_modules", "QRY4 SRT2",
       f"""WITH {MODULES} SELECT scan_id, module, finding_count, {D('total_cost_usd')} AS total_cost_usd,
           max_severity FROM modules WHERE scan_id = {ONE}""", ("findings",))
def scan_modules(t):
    return modules(t, store.scan_by_id(t.scans, ONE)).orderBy(*fops.module_order()).select(
        "scan_id", "module", "finding_count", "total_cost_usd", "max_severity")


@query("qry5_scan_roadmap", "QRY5",
       f"""WITH {ROADMAP} SELECT scan_id, bucket, position, finding_key AS finding_id FROM roadmap WHERE scan_id =
           {ONE}""", ("findings",))
def scan_roadmap(t):
    found = store.of_scans(t.findings, store.scan_by_id(t.scans, ONE)).withColumn("id", F.col("finding_key"))
    return fops.roadmap(found, ("scan_id",), ties=("seq",)).select("scan_id", "bucket", "position", "finding_id")


# --- comparison -----------------------------------------------------------------------------------

@query("jon9_scan_comparison", "JON9 SET2 WIN12 JON10",
       f"""WITH {CHANGES} SELECT repo_id, finding_key, change, coalesce(CASE WHEN change <> 'common'
           THEN NULL WHEN {RANK('to_severity')} > {RANK('from_severity')} THEN 'worsened' WHEN
           {RANK('to_severity')} < {RANK('from_severity')} THEN 'improved' END, 'none') AS
           severity_change FROM changes""", ("scans", "findings"))
def scan_comparison(t):
    return store.compare(store.scan_pairs(t.scans), t.findings).select(
        "repo_id", "finding_key", "change",
        F.coalesce("severity_change", F.lit("none")).alias("severity_change"))


@query("qry6_compare_summary", "QRY6 JON9",
       f"""WITH {PAIRS}, n AS (SELECT scan_id, count(*) AS n FROM findings GROUP BY scan_id)
           SELECT repo_id, latest_scan_id, coalesce(previous_scan_id, -1) AS previous_scan_id,
           {R('latest_cost::DOUBLE - coalesce(previous_cost, 0)::DOUBLE')} AS cost_delta_usd,
           {R('latest_score::DOUBLE - coalesce(previous_score, 0)::DOUBLE')} AS debt_score_delta,
           {R('latest_hours::DOUBLE - coalesce(previous_hours, 0)::DOUBLE')} AS hours_delta,
           coalesce(a.n, 0) - coalesce(b.n, 0) AS finding_count_delta FROM pairs
           LEFT JOIN n a ON a.scan_id = latest_scan_id LEFT JOIN n b ON b.scan_id = previous_scan_id""",
       ("scans", "findings"))
def compare_summary(t):
    pairs = store.scan_pairs(t.scans)
    shown = pairs.select(F.explode(F.array("latest_scan_id", "previous_scan_id")).alias("scan_id"))
    counts = store.of_scans(t.findings, shown).groupBy("scan_id").agg(F.count("*").alias("findings"))
    return store.compare_summary(pairs, counts).withColumn(
        "previous_scan_id", F.coalesce("previous_scan_id", F.lit(-1)))


ROLLUP = """SELECT repo_id, CASE change WHEN 'added' THEN 'new' WHEN 'removed' THEN 'resolved' ELSE
'existing' END AS state, count(*) AS findings, CAST(sum(cost) AS DOUBLE) AS cost_usd FROM {src}
GROUP BY ALL"""


@query("agg19_change_rollup", "AGG19 QRY13",
       f"WITH {CHANGES} {ROLLUP.format(src='changes')}", ("scans", "findings"))
def change_rollup(t):
    return store.change_rollup(store.compare(store.scan_pairs(t.scans), t.findings))


@query("agg19_first_scan", "AGG19 QRY13",
       f"""WITH {PAIRS} SELECT repo_id, 'new' AS state, count(*) AS findings, {D('sum(cost_usd)')} AS
           cost_usd FROM findings JOIN pairs ON scan_id = latest_scan_id WHERE previous_scan_id IS
           NULL GROUP BY repo_id""", ("scans", "findings"))
def first_scan(t):
    return store.first_scan_rollup(store.scan_pairs(t.scans), t.findings)


@query("qry13_changes", "QRY13 AGG19",
       f"""WITH {CHANGES} {ROLLUP.format(src='changes JOIN pairs USING (repo_id) WHERE previous_scan_id IS NOT NULL')}
           UNION ALL SELECT repo_id, 'new', count(*), {D('sum(cost_usd)')} FROM findings JOIN pairs ON scan_id =
           latest_scan_id WHERE previous_scan_id IS NULL GROUP BY repo_id""", ("scans", "findings"))
def all_changes(t):
    """First scans and scan pairs in one result."""
    return store.whole_change_rollup(store.scan_pairs(t.scans), t.findings)


@query("agg20_category_deltas", "AGG20",
       f"""WITH {CHANGES} SELECT repo_id, category, count(*) FILTER (change = 'added') AS new,
           count(*) FILTER (change = 'removed') AS resolved, count(*) FILTER (change = 'added') -
           count(*) FILTER (change = 'removed') AS net FROM changes WHERE change <> 'common'
           GROUP BY ALL""", ("scans", "findings"))
def category_deltas(t):
    return store.category_deltas(store.compare(store.scan_pairs(t.scans), t.findings))


@query("qry6_listed_changes", "QRY6 SRT11",
       f"""WITH {CHANGES} SELECT repo_id, position, finding_key, file_path FROM (SELECT *, row_number()
           OVER (PARTITION BY repo_id ORDER BY seq) AS position FROM changes WHERE change = 'added')
           WHERE position <= 50""", ("scans", "findings"))
def listed_changes(t):
    changes = store.compare(store.scan_pairs(t.scans), t.findings)
    return store.change_items(changes, "added", 50).select(
        "repo_id", "position", "finding_key", F.col("latest_file_path").alias("file_path"))


@query("qry6_change_lists", "QRY6 WIN12",
       f"""WITH {CHANGES}, kinds AS (SELECT *, CASE WHEN change <> 'common' THEN change WHEN {RANK('to_severity')} >
           {RANK('from_severity')} THEN 'worsened' WHEN {RANK('to_severity')} < {RANK('from_severity')} THEN
           'improved' END AS kind FROM changes) SELECT repo_id, kind, position, finding_key FROM (SELECT *,
           row_number() OVER (PARTITION BY repo_id, kind ORDER BY seq) AS position FROM kinds WHERE kind IS NOT
           NULL) WHERE position <= 50""", ("scans", "findings"))
def change_lists(t):
    """Added, removed, worsened and improved findings, the first fifty of each."""
    return store.change_lists(store.compare(store.scan_pairs(t.scans), t.findings), 50).select(
        "repo_id", "kind", "position", "finding_key")


# --- trends ---------------------------------------------------------------------------------------

@query("agg18_category_trend", "AGG18 QRY8",
       f"""WITH {RECENT.format(n=20)} SELECT repo_id, scan_id, category, count(*) AS findings,
           {D('sum(cost_usd)')} AS cost_usd FROM findings JOIN recent USING (scan_id) GROUP BY ALL""",
       ("scans", "findings"))
def category_trend(t):
    return store.scan_category_trend(store.history(t.scans, 20), t.findings).drop("created_at")


@query("agg18_rolled_up_trend", "AGG18 QRY8",
       f"""WITH {RECENT.format(n=20)} SELECT repo_id, scan_id, category, count(*) AS findings,
           {D('sum(cost_usd)')} AS cost_usd FROM findings JOIN recent USING (scan_id) GROUP BY ALL""",
       ("scans", "findings"))
def rolled_up_trend(t):
    """The trend from rollups by scan and category, as they are written with a scan."""
    rollups = stage(store.finding_rollups(t.findings.join(t.scans.select("scan_id", "repo_id"), "scan_id")))
    return store.rolled_up_category_trend(store.history(t.scans, 20), rollups).drop("created_at")


@query("agg18_rolled_up_active", "AGG18 QRY8 FLT5",
       f"""WITH {RECENT.format(n=20)}, {TRIAGED} SELECT repo_id, r.scan_id, coalesce(n, 0) AS
           active_finding_count, {D('coalesce(cost, 0)')} AS active_cost_usd FROM recent r LEFT JOIN
           (SELECT scan_id, count(*) AS n, sum(cost_usd) AS cost FROM triaged WHERE status = 'open'
           AND NOT suppressed GROUP BY scan_id) a USING (scan_id)""", (*T3, "scans"))
def rolled_up_active(t):
    rollups = stage(store.finding_rollups(t.findings.join(t.scans.select("scan_id", "repo_id"), "scan_id")))
    return store.rolled_up_active_trend(store.history(t.scans, 20), rollups, t.findings, t.suppressions, t.feedback).drop("created_at")


@query("agg18_active_trend", "AGG18 QRY8 FLT5",
       f"""WITH {RECENT.format(n=20)}, {TRIAGED} SELECT repo_id, r.scan_id, coalesce(n, 0) AS
           active_finding_count, {D('coalesce(cost, 0)')} AS active_cost_usd FROM recent r LEFT JOIN
           (SELECT scan_id, count(*) AS n, sum(cost_usd) AS cost FROM triaged WHERE status = 'open'
           AND NOT suppressed GROUP BY scan_id) a USING (scan_id)""", (*T3, "scans"))
def active_trend(t):
    recent = store.history(t.scans, 20)
    return store.active_trend(recent, triaged(t, recent)).drop("created_at")


@query("win6_category_first_last", "WIN6 QRY8",
       f"""WITH {RECENT.format(n=20)}, points AS (SELECT repo_id, scan_id, created_at, category,
           count(*) AS n, sum(cost_usd) AS cost FROM findings JOIN recent USING (scan_id) GROUP BY ALL)
           SELECT DISTINCT repo_id, category, last_value(n) OVER w - first_value(n) OVER w AS
           count_delta, {D('last_value(cost) OVER w - first_value(cost) OVER w')} AS cost_delta_usd
           FROM points WINDOW w AS (PARTITION BY repo_id, category ORDER BY created_at, scan_id ROWS
           BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", ("scans", "findings"))
def category_first_last(t):
    points = store.scan_category_trend(store.history(t.scans, 20), t.findings)
    return store.first_last_delta(points, ["repo_id", "category"], "findings", "cost_usd")


@query("win6_module_first_last", "WIN6 AGG18 QRY8",
       f"""WITH {RECENT.format(n=20)}, {MODULES}, points AS (SELECT repo_id, created_at, m.* FROM
           modules m JOIN recent USING (scan_id))
           SELECT DISTINCT repo_id, module, last_value(finding_count) OVER w -
           first_value(finding_count) OVER w AS count_delta, {D('''last_value(total_cost_usd) OVER w -
           first_value(total_cost_usd) OVER w''')} AS cost_delta_usd, last_value(max_severity) OVER w
           AS latest_max_severity FROM points WINDOW w AS (PARTITION BY repo_id, module ORDER BY
           created_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
       ("scans", "findings"))
def module_first_last(t):
    recent = store.history(t.scans, 20)
    points = store.module_trend(recent, modules(t, recent))
    deltas = store.first_last_delta(points, ["repo_id", "module"], "finding_count",
                                    "total_cost_usd")
    return deltas.join(store.latest_module_severity(points), ["repo_id", "module"])


@query("qry8_rich_trend", "QRY8",
       f"""WITH {RECENT.format(n=20)}, {MODULES}, {ROADMAP} SELECT repo_id, r.scan_id,
           strftime(created_at, '%b %d') AS date_display, coalesce(f.n, 0) AS finding_count,
           coalesce(m.n, 0) AS module_count, coalesce(p.q, 0) AS quick_wins, coalesce(p.s, 0) AS
           strategic_items FROM recent r LEFT JOIN (SELECT scan_id, count(*) AS n FROM findings GROUP BY
           scan_id) f USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) AS n FROM modules GROUP BY
           scan_id) m USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) FILTER (bucket =
           'quick_wins') AS q, count(*) FILTER (bucket = 'strategic') AS s FROM roadmap GROUP BY
           scan_id) p USING (scan_id)""", ("scans", "findings"))
def rich_trend(t):
    recent = store.history(t.scans, 20)
    return store.rich_trend(recent, t.findings, modules(t, recent), roadmap(t)).select(
        "repo_id", "scan_id", "date_display", "finding_count", "module_count", "quick_wins",
        "strategic_items")


@query("agg31_summary_rollup", "AGG31 QRY10 QRY2",
       f"""WITH {RECENT.format(n=1)}, {TRIAGED}, {MODULES}, {ROADMAP} SELECT repo_id, r.scan_id,
           {D('r.total_cost_usd')} AS total_cost_usd, coalesce(f.n, 0) AS total_findings,
           coalesce(f.o, 0) AS active_findings, coalesce(f.s, 0) AS suppressed_findings,
           coalesce(m.n, 0) AS module_count, coalesce(p.q, 0) AS quick_wins, coalesce(p.s, 0) AS
           strategic_items FROM recent r LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER
           (status = 'open') AS o, count(*) FILTER (suppressed) AS s FROM triaged GROUP BY scan_id) f
           USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) AS n FROM modules GROUP BY scan_id) m
           USING (scan_id) LEFT JOIN (SELECT scan_id, count(*) FILTER (bucket = 'quick_wins') AS q,
           count(*) FILTER (bucket = 'strategic') AS s FROM roadmap GROUP BY scan_id) p
           USING (scan_id)""", (*T3, "scans"))
def summary_rollup(t):
    latest = store.latest_scans(t.scans)
    return store.summary_rollup(t.scans, triaged(t, latest), modules(t, latest), roadmap(t)).select(
        "repo_id", "scan_id", "total_cost_usd", "total_findings", "active_findings",
        "suppressed_findings", "module_count", "quick_wins", "strategic_items")


@query("qry10_summary", "QRY10 AGG31",
       f"""WITH {CHANGES}, {TRIAGED}, roll AS ({ROLLUP.format(src='changes JOIN pairs USING (repo_id) WHERE previous_scan_id IS NOT NULL')}
           UNION ALL SELECT repo_id, 'new', count(*), 0 FROM findings JOIN pairs ON scan_id = latest_scan_id WHERE
           previous_scan_id IS NULL GROUP BY repo_id), counts AS (SELECT repo_id, CAST(coalesce(sum(findings) FILTER
           (state = 'new'), 0) AS BIGINT) AS n, CAST(coalesce(sum(findings) FILTER (state = 'existing'), 0) AS BIGINT) AS e,
           CAST(coalesce(sum(findings) FILTER (state = 'resolved'), 0) AS BIGINT) AS r FROM roll GROUP BY repo_id), stats AS
           (SELECT scan_id, count(*) AS total, count(*) FILTER (suppressed) AS muted, count(*) FILTER (status = 'reviewed')
           AS reviewed FROM triaged GROUP BY scan_id)
           SELECT p.repo_id, latest_scan_id AS scan_id, 'bus' || latest_scan_id AS ownership_summary,
           coalesce({R('muted::DOUBLE / total * 100', 1)}, 0) AS suppression_rate,
           coalesce({R('reviewed::DOUBLE / total * 100', 1)}, 0) AS review_rate, coalesce(n, 0) AS new_findings,
           coalesce(e, 0) AS existing_findings, coalesce(r, 0) AS resolved_findings FROM pairs p LEFT JOIN stats ON scan_id
           = latest_scan_id LEFT JOIN counts USING (repo_id)""", (*T3, "scans"))
def summary(t):
    scans = t.scans.withColumn("payload", F.concat(F.lit('{"ownership_summary":"bus'), "scan_id", F.lit('"}')))
    latest = store.latest_scans(scans)
    rollup = store.summary_rollup(scans, triaged(t, latest), modules(t, latest), roadmap(t))
    changes = store.whole_change_rollup(store.scan_pairs(scans), t.findings)
    return store.with_changes(rollup, changes).select(
        "repo_id", "scan_id", "ownership_summary", "suppression_rate", "review_rate", "new_findings", "existing_findings",
        "resolved_findings")


@query("agg31_top_modules", "AGG31 SRT2 SRT11",
       f"""WITH {MODULES} SELECT scan_id, module, position, max_severity, {D('total_cost_usd')} AS
           total_cost_usd FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY
           {RANK('max_severity')} DESC, total_cost_usd DESC, module) AS position FROM modules)
           WHERE position <= 5""", ("findings",))
def top_modules(t):
    return store.top_modules(modules(t), ["scan_id"]).select(
        "scan_id", "module", "position", "max_severity", "total_cost_usd")


# --- portfolio ------------------------------------------------------------------------------------

CATS = f"""cats AS (SELECT l_orderkey AS scan_id, {CATEGORY_OF_PART} AS category,
sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost_usd, sum(CAST(l_quantity / 4 AS DECIMAL(18,2))) AS
hours, count(*) AS item_count FROM lineitem GROUP BY ALL)"""


def scan_categories(t):
    return t.findings.groupBy("scan_id", "category").agg(F.sum("cost_usd").alias("cost_usd"))


_KEY_OF = """CASE WHEN contains(short, '/') THEN string_split(short, '/')[1] || '/' ||
string_split(short, '/')[2] ELSE short END"""
_SHORT = ("regexp_replace(regexp_replace(trim({u}), '/+$', ''), "
          "'^(?:https://|http://|)github\\.com/', '')")
URLS = f"""urls AS (SELECT *, {_KEY_OF.replace('short', _SHORT.format(u='url'))} AS repo_key FROM (
SELECT s.*, r.github_url AS repository_url, coalesce(nullif(payload_url, ''), nullif(r.github_url, ''),
'') AS url FROM scans s LEFT JOIN (SELECT repo_id, github_url FROM repositories) r USING (repo_id)))"""


@query("arr1_top_category", "ARR1",
       f"""WITH {CATS} SELECT scan_id, {TITLE('category')} AS top_category FROM (SELECT *, row_number()
           OVER (PARTITION BY scan_id ORDER BY cost_usd DESC, category) AS p FROM cats) WHERE p = 1""")
def top_category(t):
    return store.top_category(scan_categories(t))


@query("qry14_portfolio", "QRY14 WIN3 JON11 ARR1 PRJ14 JSN2",
       f"""WITH {CATS}, {URLS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY
           user_id, coalesce(nullif(repo_key, ''), repo_id) ORDER BY created_at DESC, scan_id DESC) AS
           p FROM urls WHERE status = 'complete') WHERE p = 1)
           SELECT user_id, repo_key, n.scan_id, CASE WHEN url LIKE 'http%' THEN url ELSE
           'https://github.com/' || repo_key END AS github_url, {D('debt_score')} AS debt_score,
           {D('total_cost_usd')} AS total_cost, {D('total_hours')} AS remediation_hours,
           CASE WHEN n.scan_id % 3 = 0 THEN 'go' ELSE coalesce(primary_language, 'Unknown') END AS language,
           CASE WHEN n.scan_id % 3 = 0 THEN 4 ELSE 0 END AS team_size, 0 AS bus_factor, n.scan_id % 3 = 0 AS has_tests,
           false AS has_ci_cd, coalesce({TITLE('c.category')},
           'unknown') AS top_category, CASE WHEN debt_score >= 7 THEN 'critical' WHEN debt_score >= 5
           THEN 'high' WHEN debt_score >= 3 THEN 'medium' ELSE 'low' END AS risk_level
           FROM newest n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
           ORDER BY cost_usd DESC, category) AS q FROM cats) WHERE q = 1) c USING (scan_id)""",
       ("scans", "repositories"))
def portfolio(t):
    document = F.when(F.col("scan_id") % 3 == 0, F.lit(
        '{"raw_analysis":{"repo_profile":{"tech_stack":{"primary_language":"go","has_tests":true},"team":'
        '{"estimated_team_size":4}}}}')).otherwise("{}")
    return store.portfolio(t.scans.withColumn("payload", document), t.repositories, scan_categories(t)).drop("scanned_at")


@query("srt9_portfolio_sort", "SRT9 SRT8 QRY14",
       f"""WITH {URLS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id,
           coalesce(nullif(repo_key, ''), repo_id) ORDER BY created_at DESC, scan_id DESC) AS p FROM
           urls WHERE status = 'complete') WHERE p = 1)
           SELECT user_id, repo_key, {D('total_cost_usd')} AS total_cost, strftime(created_at,
           '%Y-%m-%dT%H:%M:%S') AS scanned_at FROM newest""",
       ("scans", "repositories"))
def portfolio_sort(t):
    rows = store.portfolio(t.scans, t.repositories, scan_categories(t))
    return store.sort_portfolio(rows, "total_cost", descending=False).select(
        "user_id", "repo_key", "total_cost", "scanned_at")


@query("srt8_portfolio_order", "SRT8 SRT9",
       f"""SELECT scan_id, {D('debt_score')} AS debt_score, row_number() OVER (PARTITION BY user_id ORDER BY
           debt_score DESC, scan_id) AS position FROM scans WHERE status = 'complete'""", ("scans",))
def portfolio_order(t):
    return top_per_group(store.complete(t.scans), ["user_id"],
                         [F.col("debt_score").desc(), F.col("scan_id")], None).select("scan_id", "debt_score", "position")


@query("agg21_portfolio_summary", "AGG21 QRY15",
       f"""SELECT user_id, count(DISTINCT repo_id) AS total_repos, count(*) AS total_scans,
           {R('sum(debt_score)::DOUBLE / count(*)', 1)} AS avg_debt_score, {D('sum(total_cost_usd)')} AS
           total_cost_usd, {D('sum(total_hours)')} AS total_hours, {D('max(debt_score)')} AS
           worst_score, {D('min(debt_score)')} AS best_score FROM scans WHERE status = 'complete'
           GROUP BY user_id""", ("scans",))
def portfolio_summary(t):
    return store.portfolio_summary(t.scans, keys=("user_id",))


@query("win10_portfolio_trends", "WIN10 QRY16",
       f"""SELECT user_id, repo_id, scan_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS date,
           {D('debt_score')} AS score, {D('total_cost_usd')} AS cost FROM scans WHERE status =
           'complete'""", ("scans",))
def portfolio_trends(t):
    return store.portfolio_trends(t.scans)


@query("agg28_repository_list", "AGG28 QRY9 SRT10",
       f"""WITH {RECENT.format(n=1)} SELECT r.repo_id, repo_name, language, coalesce(n, 0) AS
           total_scans, coalesce({D('x.total_cost_usd')}, -1) AS latest_cost,
           coalesce({D('x.debt_score')}, -1) AS latest_score FROM repositories r LEFT JOIN (SELECT
           repo_id, count(*) AS n FROM scans GROUP BY repo_id) USING (repo_id) LEFT JOIN recent x
           USING (repo_id)""", ("scans", "repositories"))
def repository_list(t):
    listed = store.repository_list(t.repositories, t.scans)
    return listed.select("repo_id", "repo_name", "language", "total_scans",
                         *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c)
                           for c in ("latest_cost", "latest_score")])


@query("srt10_recent_repositories", "SRT10 QRY9",
       f"""WITH {RECENT.format(n=1)} SELECT r.repo_id, coalesce(strftime(created_at, '%Y-%m-%d'), '') AS
           last_scanned FROM repositories r LEFT JOIN recent x USING (repo_id)""", ("scans", "repositories"))
def recent_repositories(t):
    listed = store.recently_scanned(store.repository_list(t.repositories, t.scans))
    return listed.select("repo_id", F.coalesce(F.date_format("last_scanned", "yyyy-MM-dd"), F.lit(""))
                         .alias("last_scanned"))


@query("qry2_scan_summary", "QRY2 JSN1",
       f"""SELECT scan_id, repo_id, job_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at,
           {D('total_cost_usd')} AS total_cost_usd, {D('debt_score')} AS debt_score, {D('total_hours')} AS
           total_hours, {D('total_sprints')} AS total_sprints, CASE WHEN scan_id % 2 = 0 THEN
           '{{"issues":' || scan_id || '}}' ELSE '{{}}' END AS summary, CASE WHEN scan_id % 2 = 0 THEN
           '{{"security":{{"cost_usd":1}}}}' ELSE '{{}}' END AS cost_by_category FROM scans""", ("scans",))
def scan_summary(t):
    payload = F.when(F.col("scan_id") % 2 == 0, F.concat(
        F.lit('{"raw_analysis":{"cost_by_category":{"security":{"cost_usd":1}},"summary":{"issues":'), "scan_id",
        F.lit("}}}"))).otherwise("{}")
    return store.scan_summary(t.scans.withColumn("payload", payload))


@query("jsn2_profile_fields", "JSN2",
       """SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN 'go' ELSE coalesce(primary_language, 'Unknown') END
          AS language FROM scans""", ("scans",))
def profile_fields(t):
    payload = F.when(F.col("scan_id") % 3 == 0, F.lit(
        '{"repo_profile":{"tech_stack":{"primary_language":"go"}}}')).otherwise("{}")
    return t.scans.select("scan_id", store.profile_field(
        payload, "tech_stack.primary_language", F.col("primary_language"), "Unknown").alias("language"))


@query("qry18_all_scans", "QRY18 JON11 STR5",
       f"""WITH {URLS} SELECT scan_id, repo_id, coalesce(repository_url, '') AS repository_url,
           repo_key AS normalized FROM urls""", ("scans", "repositories"))
def all_scans(t):
    return store.scans_with_keys(t.scans, t.repositories).select(
        "scan_id", "repo_id", F.coalesce("repository_url", F.lit("")).alias("repository_url"),
        "normalized")


@query("dml4_remove_repository", "DML4",
       "SELECT user_id, count(*) AS scans FROM scans WHERE NOT (user_id = 6 AND repo_id = 'hub') "
       "GROUP BY user_id", ("scans",))
def remove_repository(t):
    from arrears.sources.scan_store import without_repo

    return without_repo(t.scans, 6, "hub").groupBy("user_id").agg(F.count("*").alias("scans"))


@query("dml1_repository_upsert", "DML1 STR3",
       """WITH known AS (SELECT 'https://github.com/org' || (c_custkey % 10) || '/repo' || c_custkey AS
          url, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END AS user_id FROM customer), seen AS (SELECT 'https://github.com/org' || (o_custkey % 10) || '/repo' ||
          o_custkey AS url, min(o_custkey % 4) AS user_id FROM orders GROUP BY ALL)
          SELECT coalesce(k.url, s.url) AS github_url, string_split(coalesce(k.url, s.url), '/')[-1] AS
          repo_name, string_split(coalesce(k.url, s.url), '/')[-2] AS repo_owner,
          coalesce(k.user_id, s.user_id, -1) AS user_id FROM known k FULL JOIN seen s ON k.url =
          s.url""")
def repository_upsert(t):
    from arrears.sources.scan_store import merge_repositories

    known = t.read("customer").selectExpr(
        "'https://github.com/org' || (c_custkey % 10) || '/repo' || c_custkey AS github_url",
        "CAST(NULL AS STRING) AS repo_name", "CAST(NULL AS STRING) AS repo_owner",
        "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END AS user_id")
    seen = t.read("orders").selectExpr(
        "'github.com/org' || (o_custkey % 10) || '/repo' || o_custkey || '/' AS github_url",
        "o_custkey % 4 AS user_id")
    return merge_repositories(known, seen).withColumn(
        "user_id", F.coalesce("user_id", F.lit(-1).cast("long")))


# --- findings, modules, roadmap -------------------------------------------------------------------

FID = """substring(sha1(coalesce(file, '') || '|' || coalesce(category, '') || '|' || coalesce(type, '')
|| '|' || coalesce("function", '') || '|' || coalesce(line::VARCHAR, '')), 1, 12)"""


@query("prj8_normalize_findings", "PRJ8 PRJ9 PRJ10 PRJ11",
       f"""SELECT repo_id, {FID} AS id, file AS file_path, CASE WHEN regexp_extract(file,
           '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(file, '^(.*)/[^/]*$', 1) END AS module,
           category, severity, {R('remediation_hours')} AS effort_hours, {D('cost_usd')} AS cost_usd,
           CASE category WHEN 'security' THEN 'bandit' WHEN 'dependency' THEN 'osv' WHEN
           'documentation' THEN 'ast' ELSE CASE WHEN used_fallback THEN 'complexity_fallback' ELSE
           'git+static' END END AS source_tool FROM items""", ("items",))
def normalize_findings(t):
    return fops.normalize_findings(t.items).select(
        "repo_id", "id", "file_path", "module", "category", "severity", "effort_hours", "cost_usd",
        "source_tool")


@query("prj12_evidence", "PRJ12 STR16 STR18",
       f"""SELECT repo_id, seq, array_to_string(list_filter([
           CASE WHEN complexity IS NOT NULL THEN 'complexity: Complexity score ' || complexity END,
           CASE WHEN change_count IS NOT NULL THEN 'git_history: Changed ' || change_count ||
             ' times in sampled history' END,
           CASE WHEN issue_text <> '' THEN 'security_scan: ' || substring(issue_text, 1, 160) END,
           CASE WHEN doc_type <> '' THEN 'documentation: Missing documentation type: ' || doc_type END,
           CASE WHEN package <> '' THEN 'dependency: Package ' || package || ' requires attention' END,
           CASE WHEN owner_count IS NOT NULL THEN 'ownership: ' || owner_count ||
             ' contributors, top contributor share ' || CAST(ROUND(top_contributor_share * 100, 0) AS
             BIGINT) || '%' END,
           CASE WHEN complexity IS NULL AND change_count IS NULL AND issue_text IS NULL AND doc_type IS
             NULL AND package IS NULL AND owner_count IS NULL THEN 'analysis: ' || category ||
             ' finding from analysis pipeline' END], lambda x: x IS NOT NULL), '; ') AS evidence
           FROM items""", ("items",))
def evidence(t):
    lines = F.transform(fops.evidence(), lambda e: F.concat_ws(": ", e["source"], e["summary"]))
    return t.items.select("repo_id", "seq", F.array_join(lines, "; ").alias("evidence"))


@query("agg11_module_summaries", "AGG11 CMP8",
       f"""SELECT repo_id, CASE WHEN regexp_extract(file, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE
           regexp_extract(file, '^(.*)/[^/]*$', 1) END AS module, count(*) AS finding_count,
           {D('sum(cost_usd)')} AS total_cost_usd, {D('sum(ROUND(remediation_hours, 2))')} AS
           total_effort_hours, {NAME(f'max({RANK("severity")})')} AS max_severity,
           {R('sum(confidence)::DOUBLE / count(*)')} AS avg_confidence FROM items GROUP BY 1, 2""",
       ("items",))
def module_summaries(t):
    return fops.summarize_modules(fops.normalize_findings(t.items))


@query("cmp9_roadmap", "CMP9 WIN7 STR7 SRT1",
       f"""WITH {ROADMAP} SELECT scan_id, bucket, position, finding_key AS finding_id,
           {TITLE('category')} || ' in ' || file_path AS title, {D('cost_usd')} AS cost_usd
           FROM roadmap WHERE position <= 10""", ("findings",))
def roadmap_items(t):
    """The listing: the first ten of each bucket."""
    return roadmap(t, C.ROADMAP_LIMIT).select("scan_id", "bucket", "position", "finding_id", "title", "cost_usd")


@query("cmp9_roadmap_all", "CMP9",
       f"""WITH {ROADMAP} SELECT scan_id, bucket, position, finding_key AS finding_id, {D('cost_usd')} AS
           cost_usd FROM roadmap""", ("findings",))
def whole_roadmap(t):
    return roadmap(t).select("scan_id", "bucket", "position", "finding_id", "cost_usd")


@query("cmp9_repo_roadmap", "CMP9 CMP8 WIN7",
       f"""WITH f AS (SELECT *, ROUND(remediation_hours, 2) AS effort_hours FROM items)
           SELECT repo_id, bucket, position, file AS file_path, severity, {D('cost_usd')} AS cost_usd
           FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, bucket ORDER BY {ORDER}, seq) AS
           position FROM (SELECT *, {BUCKET} AS bucket FROM f)) WHERE position <= 10""", ("items",))
def repo_roadmap(t):
    found = t.items.withColumn("effort_hours", F.round("remediation_hours", 2)).withColumn(
        "file_path", F.col("file")).withColumn("id", F.col("seq")).withColumn("module", F.col("file"))
    return fops.roadmap(found, limit=C.ROADMAP_LIMIT, ties=("seq",)).select(
        "repo_id", "bucket", "position", "file_path", "severity", "cost_usd")


_FIXED = "('code_quality'), ('architecture'), ('security'), ('documentation'), ('dependency'), ('test_debt')"
CATCOST = f"""catcost AS (SELECT repo_id, category, coalesce(c, 0) AS cost_usd, ROUND(coalesce(h, 0), 2)
AS hours, coalesce(n, 0) AS item_count FROM (SELECT DISTINCT repo_id, category FROM (SELECT repo_id,
category FROM (SELECT DISTINCT repo_id FROM items), (VALUES {_FIXED}) v(category) UNION SELECT repo_id,
category FROM items)) LEFT JOIN (SELECT repo_id, category, sum(cost_usd) AS c, sum(remediation_hours) AS
h, count(*) AS n FROM items GROUP BY ALL) USING (repo_id, category))"""


@query("agg8_category_costs", "AGG8 MAP1",
       f"""WITH {CATCOST} SELECT repo_id, category, {D('cost_usd')} AS cost_usd, {D('hours')} AS hours,
           item_count FROM catcost""", ("items",))
def category_costs(t):
    return fops.category_costs(t.items)


@query("agg30_category_report", "AGG30 FLT9",
       f"""WITH {CATCOST}, tot AS (SELECT repo_id, sum(cost_usd) * 2 AS total FROM items GROUP BY
           repo_id) SELECT repo_id, category, {TITLE('category')} AS label, item_count,
           {R('cost_usd::DOUBLE / total::DOUBLE * 100', 1)} AS pct_of_total,
           {R('''cost_usd::DOUBLE / (sum(cost_usd) OVER (PARTITION BY repo_id))::DOUBLE * 100''', 1)}
           AS pct_of_shown FROM catcost JOIN tot USING (repo_id) WHERE cost_usd > 0""", ("items",))
def category_report(t):
    shown = fops.category_costs(t.items).filter("cost_usd > 0")
    totals = t.items.groupBy("repo_id").agg((F.sum("cost_usd") * 2).alias("total_cost_usd"))
    return fops.category_report(shown, totals).select(
        "repo_id", "category", "label", "item_count", "pct_of_total", "pct_of_shown")


@query("agg9_repo_totals", "AGG9 AGG10 PRJ20 PRJ19",
       f"""WITH r AS (SELECT repo_id, count(*) * 40 AS fns, 1.8::DOUBLE AS m, sum(cost_usd)::DOUBLE AS
           c, sum(remediation_hours)::DOUBLE AS h, count(*) AS n FROM items GROUP BY repo_id),
           b AS (SELECT *, {R('''fns::DOUBLE * 0.2::DOUBLE * 84.55::DOUBLE * 0.9::DOUBLE *
           0.35::DOUBLE''')} AS base FROM r), x AS (SELECT *, (c + base) * m AS cost, h + fns::DOUBLE *
           0.2::DOUBLE * m AS hours FROM b)
           SELECT repo_id, fns AS functions_analyzed, n AS issues_found, base AS baseline_cost,
           {R('cost')} AS total_cost_usd, {R('hours')} AS total_hours, {R('hours / 80')} AS
           total_sprints, {R('least(10::DOUBLE, cost / fns::DOUBLE / 433.0::DOUBLE * 10)')} AS
           debt_score FROM x""", ("items",))
def repo_totals(t):
    repos = t.items.groupBy("repo_id").agg((F.count("*") * 40).alias("functions")).select(
        "repo_id", "functions", F.lit(84.55).alias("rate"), F.lit(1.8).alias("multiplier"),
        F.lit(433.0).alias("benchmark"))
    return fops.repo_totals(t.items, repos).select(
        "repo_id", "functions_analyzed", "issues_found", "baseline_cost", "total_cost_usd",
        "total_hours", "total_sprints", "debt_score")


@query("snk1_store_limits", "SRT11",
       f"""SELECT 'findings' AS kind, repo_id, count(*) AS kept, {D('sum(cost_usd)')} AS cost FROM (
           SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {ORDER}, seq) AS p FROM items)
           WHERE p <= 250 GROUP BY repo_id""", ("items",))
def store_limits(t):
    from arrears.sources.scan_store import stored_findings

    rows = t.items.withColumn("scan_id", F.lit(1)).withColumn("file_path", F.col("file"))
    return stored_findings(rows, C.STORE_LIMITS["findings"], ("seq",)).groupBy("repo_id").agg(
        F.count("*").alias("kept"), F.sum("cost_usd").alias("cost")).withColumn(
        "kind", F.lit("findings"))


@query("jsn1_payload_analysis", "JSN1",
       """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN json_extract_string(props, '$.k')
          WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.k') END, '0') AS k FROM events""")
def payload_analysis(t):
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"raw_analysis":'), "props",
                                                         F.lit(',"k":"x"}'))
                     ).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("{}")
    return t.read("events").select("event_id", F.coalesce(
        store.payload_analysis(payload, "k"), F.lit("0")).alias("k"))


@query("jon8_payload_owners", "JON8 QRY3",
       """SELECT scan_id, seq, coalesce(CASE WHEN finding_key = 'f-' || (scan_id % 25) THEN scan_id % 7 WHEN
          finding_key = 'f-' || ((scan_id + 3) % 25) THEN 1 END, -1) AS owner_count FROM findings""", ("findings", "scans"))
def payload_owners(t):
    payload = F.concat(F.lit('{"raw_analysis":{"findings":[{"id":"f-'), F.col("scan_id") % 25, F.lit('","owner_count":'),
                       F.col("scan_id") % 7, F.lit('},{"id":"f-'), (F.col("scan_id") + 3) % 25,
                       F.lit('","owner_count":1,"ownership_risk":"high"}]}}'))
    return store.with_payload_owners(t.findings, t.scans.withColumn("payload", payload)).select(
        "scan_id", "seq", F.coalesce("owner_count", F.lit(-1).cast("long")).alias("owner_count"))


@query("snk1_store_round_trip", "SNK1 SRC9",
       f"""WITH {RECENT.format(n=1).replace('scan_id DESC', 'CAST(scan_id AS VARCHAR) DESC')}, {ROADMAP} SELECT
           r.repo_id, CAST(r.scan_id AS VARCHAR) AS scan_id,
           {D('r.total_cost_usd')} AS total_cost_usd, coalesce(n, 0) AS findings, coalesce({D('cost')}, 0) AS
           cost_usd, coalesce(first_key, '') AS first_finding, coalesce(q, 0) AS quick_wins FROM recent r LEFT JOIN
           (SELECT scan_id, count(*) AS n, sum(cost_usd) AS cost FROM findings GROUP BY scan_id) USING (scan_id)
           LEFT JOIN (SELECT scan_id, file_path AS first_key FROM (SELECT *, row_number() OVER (PARTITION BY scan_id
           ORDER BY {ORDER}, seq, file_path) AS p FROM findings) WHERE p = 1) USING (scan_id) LEFT JOIN (SELECT
           scan_id, count(*) FILTER (bucket = 'quick_wins') AS q FROM roadmap GROUP BY scan_id) USING (scan_id)""",
       ("scans", "findings"))
def store_round_trip(t):
    """Scans are written to a store in the shared folder; the answers come from what is read back."""
    from arrears.operators.common import shared_folder
    from arrears.sources import scan_store

    repos = t.scans.select("scan_id", "repo_id")
    found = t.findings.join(repos, "scan_id").withColumns({
        "step": F.col("seq"), "line_start": F.lit(None).cast("int"), "symbol_name": F.lit(""), "subcategory": F.lit(""),
        "id": F.col("finding_key")})
    root = f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}"
    items = found.select("repo_id", "scan_id", F.col("file_path").alias("file"), "category", "severity", "cost_usd")
    scan_store.save_scan(root, "batch", t.scans, items, found, modules(t).join(repos, "scan_id"),
                         roadmap(t).join(repos, "scan_id"))
    scans, findings, plan = (scan_store.read_table(t.spark, root, name) for name in ("scans", "findings", "roadmap_items"))
    latest = store.latest_scans(scans)
    counts = store.of_scans(findings, latest).groupBy("scan_id").agg(
        F.count("*").alias("findings"), F.sum("cost_usd").alias("cost_usd"), F.min_by("file_path", "seq").alias("first_finding"))
    wins = store.of_scans(plan, latest).groupBy("scan_id").agg(F.count_if(F.col("bucket") == "quick_wins").alias("quick_wins"))
    return latest.select("repo_id", "scan_id", "total_cost_usd").join(counts, "scan_id", "left").join(wins, "scan_id", "left").fillna(
        {"findings": 0, "first_finding": "", "quick_wins": 0}).withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0)))


@query("dml4_store_of_two_batches", "DML4 DML1 SNK1 JON11 QRY18 AGG28",
       f"""WITH {URLS}, left_over AS (SELECT * FROM urls WHERE NOT (coalesce(user_id, -1) = 6 AND repo_id = 'hub')),
           n AS (SELECT scan_id, count(*) AS n, sum(cost_usd) AS cost FROM findings GROUP BY scan_id) SELECT repo_key, count(*) AS
           scans, coalesce(sum(n), 0)::BIGINT AS findings, coalesce({D('sum(cost)')}, 0) AS cost_usd, (SELECT count(*) FROM scans WHERE user_id = 6 AND
           repo_id = 'hub') AS removed FROM left_over LEFT JOIN n USING (scan_id) GROUP BY repo_key""",
       ("scans", "findings", "repositories"))
def store_of_two_batches(t):
    """Two batches that share their repositories, a removal, and a rewrite without the removed rows."""
    import datetime

    from arrears.operators.common import shared_folder
    from arrears.sources import scan_store

    root = f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}"
    payload = F.to_json(F.struct(F.col("payload_url").alias("github_url")))
    scans = t.scans.withColumn("payload", payload)
    found = t.findings.join(scans.select("scan_id", "repo_id"), "scan_id").withColumns({
        "step": F.col("seq"), "line_start": F.lit(None).cast("int"), "symbol_name": F.lit(""), "subcategory": F.lit(""),
        "id": F.col("finding_key")})
    for number in (0, 1):
        mine = scans.filter(F.col("scan_id") % 2 == number)
        seen = t.repositories.withColumn("last_scanned_at", F.lit(f"2025-01-0{number + 1}").cast("timestamp"))
        scan_store.publish(root, f"batch-{number}", {
            "scans": mine, "findings": scan_store.in_finding_order(found.filter(F.col("scan_id") % 2 == number)), "repositories": seen},
            placed=("findings",))
    removed = scan_store.remove_repository(t.spark, root, "6", "hub", datetime.datetime(2100, 1, 1))
    scan_store.purge(t.spark, root)
    kept, findings, repos = (scan_store.read_table(t.spark, root, name) for name in ("scans", "findings", "repositories"))
    counts = findings.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost"))
    return store.scans_with_keys(kept, repos).join(counts, "scan_id", "left").groupBy(F.col("normalized").alias("repo_key")).agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost_usd")).withColumn("removed", F.lit(removed).cast("long"))
