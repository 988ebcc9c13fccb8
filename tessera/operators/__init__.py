"""Operators over whole tables: compiling features, profiles, screens, folds, metrics."""
