"""Training-data operators that go beyond the core engine.

Nothing outside this package imports it; ``catalog`` lists its queries and SQL.
"""
