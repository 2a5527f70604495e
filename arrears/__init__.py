"""Code-health analytics as Spark jobs: findings, pricing, ownership, trends and triage."""
