"""featmill: feature-data preparation, checking and scoring on Spark."""
