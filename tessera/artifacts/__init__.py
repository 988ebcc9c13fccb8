"""Artifacts: what methods leave behind, how it is stored, and how methods differ."""
