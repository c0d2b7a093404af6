"""Pipelines composed from the operators (preprocess, featurize, analyze)."""
