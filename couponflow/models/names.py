"""Column names that all models share."""

FEATURES, LABEL, PROBABILITY = "features", "label", "probability"
