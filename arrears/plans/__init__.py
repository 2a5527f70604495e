"""End-to-end jobs that combine the operators."""
