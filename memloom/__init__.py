"""memloom: memory, retrieval and governance analytics as plain Spark plans."""
