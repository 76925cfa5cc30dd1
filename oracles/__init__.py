"""Reference SQL for the registered queries, written for DuckDB."""
