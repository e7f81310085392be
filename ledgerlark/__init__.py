"""Experiment analytics on Spark: ledger views, training-set preparation, evaluation, retrieval and decisions."""
