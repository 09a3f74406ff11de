"""Data jobs: DataFrame in, DataFrame out."""
