"""Composite jobs: cohort, feature table, screening, training and report."""
