"""Named queries over the fixture tables (Spark side) and their DuckDB texts."""
