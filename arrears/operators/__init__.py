"""Set-level operators: joins, aggregates, windows and rankings over repositories and scans."""
