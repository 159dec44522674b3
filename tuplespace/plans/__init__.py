"""Composed plans: the tuple job over the supplied tables, registered queries, oracle SQL."""
