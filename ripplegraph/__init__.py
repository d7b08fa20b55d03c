"""Change-impact analytics over evidence graphs, written as plain Spark DataFrame jobs."""
