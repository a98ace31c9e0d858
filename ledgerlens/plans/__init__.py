"""Query plans: the tables' projection onto filings, the planner, the catalogue of queries and their SQL."""
