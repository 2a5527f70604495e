"""Fixed values of the cost model.

Everything here is a published constant of the model: changing one changes results. The values are
stated as plain text in their natural order; no logic lives in this module.
"""

# Severity and complexity.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
COMPLEXITY_BANDS = {"low": (1, 5), "medium": (6, 10), "high": (11, 15), "critical": (16, 9999)}
COMPLEXITY_TO_RULE_SEVERITY = {
    "low": "MINOR", "medium": "MAJOR", "high": "CRITICAL", "critical": "BLOCKER",
}
RULE_SEVERITY_MINUTES = {"BLOCKER": 120, "CRITICAL": 60, "MAJOR": 30, "MINOR": 10, "INFO": 5}

# Maintenance pressure (changes at or above -> multiplier).
CHURN_STEPS = ((0, 1.0), (3, 1.3), (6, 1.7), (11, 2.2), (20, 3.0))

# Rates in USD per hour.
ROLE_RATES = {"junior": 55.10, "mid": 84.55, "senior": 128.37}
CATEGORY_ROLE = {
    "architecture": "senior", "security": "senior", "code_quality": "mid",
    "dependency": "mid", "test_debt": "junior", "documentation": "junior",
}
HOURS_PER_YEAR = 2080
ROLE_YEARS = {"junior": (0, 2), "mid": (3, 7), "senior": (8, 99)}
BLEND_WEIGHTS = {"bls": 0.40, "levels": 0.30, "so": 0.20, "ddg": 0.10}
WAGE_ROLE_FACTORS = {"junior": 0.7, "mid": 1.0, "senior": 1.5}
OFFER_ROLE_FACTORS = {"junior": 0.8, "mid": 1.0, "senior": 1.3}
OFFER_FALLBACK_FACTOR = 1.05

# Effort.
SCAN_HOURS = {"HIGH": 8.0, "MEDIUM": 4.0, "LOW": 1.5}
VULNERABILITY_HOURS = {"CRITICAL": 12.0, "HIGH": 6.0, "MEDIUM": 3.0, "LOW": 1.0, "UNKNOWN": 2.0}
VULNERABILITY_RATE = 128.37
TEST_GAP_RATE = 84.55
BASELINE_MINUTES = 12.0
BASELINE_CONFIDENCE = 0.35
DEFAULT_MULTIPLIER = 6.0
HOURS_PER_SPRINT = 80.0

# Weights.
IMPACT_WEIGHTS = {"low": 0.9, "medium": 1.0, "high": 1.2, "critical": 1.5}
CONFIDENCE = {
    "static_analysis": 0.7, "git_history": 0.8, "fallback": 0.45, "security_scan": 0.8,
    "documentation": 0.65, "dependency": 0.85, "test_debt": 0.7,
}

# Score and benchmark.
SCORE_CAP = 10.0
VARIANCE_LIMIT = 150.0
FUNCTION_BENCHMARK = 433.0
DEBT_DAYS_BENCHMARK = 15.0
DEBT_RATIO_BENCHMARK = 10.0
BREACH_COST = 4_880_000.0
BREACH_PROBABILITY = 0.046
CWE_FACTORS = {
    "CWE-79": 0.5, "CWE-89": 1.5, "CWE-22": 1.2, "CWE-78": 1.3, "CWE-352": 1.1,
    "CWE-287": 1.4, "CWE-434": 1.0, "CWE-502": 0.9, "CWE-915": 0.9,
}
CATEGORIES = ("code_quality", "architecture", "security", "documentation", "dependency", "test_debt")
ASSESSMENTS = (
    (0.5, "Lower than industry average - code may be well-maintained"),
    (1.0, "Slightly below industry average - reasonable condition"),
    (1.5, "Slightly above industry average - some technical debt present"),
    (2.0, "Above industry average - significant technical debt"),
    (None, "Significantly above industry average - high technical debt"),
)

# Path rules.
SKIP_DIRS = (
    "venv", "node_modules", ".git", "__pycache__", "dist", "build", ".next", "__generated__",
    "vendor", ".tox", "eggs", ".eggs", ".venv", "env", ".env",
)
SKIP_FILE_PATTERNS = (
    "*.min.js", "*.bundle.js", "*_pb2.py", "*.lock", "*.sum", "*.map",
    "package-lock.json", "yarn.lock", "poetry.lock",
)
TEST_NAME_PARTS = ("test_", "_test.", ".test.", ".spec.")
TEST_DIRS = ("tests", "test", "__tests__", "spec")
SOURCE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx")
NON_CODE_EXTENSIONS = (
    "txt", "md", "rst", "json", "yml", "yaml", "toml", "lock", "cfg", "ini", "pyc",
)

# Figures in free text.
DOLLAR_FIGURE = r"\$([\d,]+(?:\.\d+)?)"
DAY_FIGURE = r"(\d+(?:\.\d+)?)\s*(?:days|debt days)"
PERCENT_FIGURE = r"(\d+(?:\.\d+)?)\s*%"
MILLION_FIGURE = r"(?i)\$?([\d,\.]+)\s*(?:million|m)"
HOURLY_FIGURE = r"(?i)\$(\d+(?:\.\d+)?)\s*(?:per hour|/hr|hourly)"
THOUSANDS_FIGURE = r"(?i)\$(\d+(?:,\d+)?(?:\.\d+)?)[kK]\s*(?:per year|annual|/yr)"
YEARLY_FIGURE = r"(?i)\$(\d+(?:,\d+)+)\s*(?:per year|annual)"
DOLLAR_RANGE = (100, 10000)
MILLION_RANGE = (1, 20)
HOURLY_RANGE = (20, 300)

# Risk, multipliers and generated-code signals.
RISK_LEVELS = ((7, "critical"), (5, "high"), (3, "medium"))
OWNERSHIP_SHARES = {"critical": 0.85, "high": 0.7, "medium": 0.55}
AGE_MULTIPLIERS = ((3650, 1.4), (2000, 1.3), (1000, 1.1))
YOUNG_DAYS, YOUNG_MULTIPLIER = 180, 0.8
BUS_FACTOR_MULTIPLIERS = ((1, 2.0), (2, 1.5), (4, 1.2))
TEAM_MULTIPLIERS = ((1, 1.5), (3, 1.2), (10, 1.0))
LARGE_TEAM_MULTIPLIER = 0.9
GENERATED_PROBABILITY = 0.3

# Structure thresholds.
OVERSIZED_LINES = 400
OVERSIZED_FUNCTIONS = 8
FANOUT_IMPORTS = 10

# Technology keywords and generic names.
TECH_KEYWORDS = {
    "frameworks": (
        "django", "flask", "fastapi", "express", "nextjs", "react", "vue", "angular", "rails",
        "spring", "springboot", "laravel", "asp.net", "dotnet", "Phoenix", "Next.js", "Nuxt",
        "SvelteKit",
    ),
    "ai_ml": (
        "openai", "anthropic", "langchain", "langgraph", "transformers", "torch", "tensorflow",
        "sklearn", "xgboost", "llama", "sentence_transformers", "groq", "cohere", "mistral",
        "crewai", "autogen", "vllm", "huggingface", "gemini", "claude", "bedrock",
    ),
    "vector_dbs": ("pinecone", "weaviate", "chromadb", "qdrant", "faiss", "milvus"),
    "databases": (
        "psycopg2", "pymongo", "redis", "elasticsearch", "cassandra", "sqlalchemy", "asyncpg",
        "motor", "snowflake", "databricks", "duckdb", "postgresql", "mysql", "mariadb", "mongodb",
        "sqlite3", "supabase",
    ),
    "cloud": ("boto3", "google-cloud", "azure", "pulumi", "aws", "gcp"),
    "infra": (
        "kafka", "rabbitmq", "celery", "airflow", "kubernetes", "terraform", "prometheus",
        "grafana", "docker", "nomad",
    ),
    "testing": (
        "pytest", "jest", "mocha", "rspec", "junit", "hypothesis", "factory_boy", "playwright",
        "selenium", "cypress",
    ),
}
GENERIC_NAMES = (
    "data", "result", "response", "output", "temp", "x", "y", "res",
    "obj", "val", "item", "info", "dict", "list", "arr", "tmp",
)

# Ticket, triage and report wording.
TICKET_PRIORITY = {"critical": "Highest", "high": "High", "medium": "Medium", "low": "Low"}
TICKET_LABEL = {
    "code_quality": "tech-debt-code", "security": "tech-debt-security",
    "documentation": "tech-debt-docs", "dependency": "tech-debt-deps",
    "test_debt": "tech-debt-tests",
}
ACTION_HINTS = {
    "architecture": "Split responsibilities or break module coupling",
    "test_debt": "Add focused behavior tests around the hotspot",
    "security": "Patch the vulnerable code path and add a regression test",
    "dependency": "Pin and upgrade the dependency safely",
}
DEFAULT_ACTION_HINT = "Refactor the hotspot and simplify the code path"
DEFAULT_WHY = "This is one of the highest-cost unresolved findings in the current scan."
TRIAGE_NOTE = "Fallback heuristic review"
ROI_POSITIVE = "Prioritize the top hotspots this quarter for the strongest maintenance ROI."
ROI_OTHER = "Focus on the highest-severity findings first and defer low-impact cleanup."
ARCHITECTURE_SUMMARY = (
    "Architecture risk is concentrated in %s and related structural hotspots."
)
ARCHITECTURE_BOUNDARY = (
    "Split orchestration, state management, and external integrations into clearer module "
    "boundaries."
)
TEST_GAP_SUMMARY = (
    "Test coverage is weakest around %s, which raises change risk for hotspot code."
)
TEST_GAP_STYLE = "Add behavior-level tests around core flows and edge cases."
SUMMARY_CLOSING = (
    "Start with the top hotspots and their surrounding tests to reduce both change risk and "
    "maintenance drag."
)
GENERATED_TEXTS = {
    "none": "No obvious AI-generated code patterns",
    "some": "Review suspected files for quality issues",
    "many": "High AI usage detected - consider code review",
}

# Store limits.
STORE_LIMITS = {"debt_items": 100, "findings": 250, "modules": 200, "roadmap": 100}
ROADMAP_LIMIT = 10
REVIEWED_FEEDBACK = ("false_positive", "accepted_risk")
