"""Named queries over the driver tables, each with the same in DuckDB's SQL where it can be said."""
