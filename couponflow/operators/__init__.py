"""Reusable relational building blocks: folds, skew-safe joins, sampling, AUC, scaling."""
