"""Report definitions: each binds operators to tables and states the same result in SQL."""
