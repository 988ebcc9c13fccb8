"""Experiments: matrices of runs, runners, reports and trackers."""
