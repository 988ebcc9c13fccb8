"""Plans: evaluation, rounds, methods, and the catalogue of queries."""
