"""Named queries, their DuckDB counterparts and the end-to-end run."""
