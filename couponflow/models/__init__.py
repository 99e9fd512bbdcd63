"""Training, tuning, stacking and scoring with ``pyspark.ml``."""
