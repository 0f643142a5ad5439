"""Whole jobs: features, history, degradation, strategy, training, scoring."""
