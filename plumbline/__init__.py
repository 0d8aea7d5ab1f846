"""Data-quality scanning, scoring, fixing and trending on Spark DataFrames."""
