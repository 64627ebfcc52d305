"""The registered queries, their test model and their oracle SQL."""
