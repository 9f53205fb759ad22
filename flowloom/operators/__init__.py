"""Data-processing operators of general use: DataFrame in, DataFrame out."""
