"""The registered queries, their inputs derived from the given tables, and the same queries as SQL."""
