"""Operators put together: the feature table, the test-table bindings, the jobs."""
