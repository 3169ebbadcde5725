"""Asymmetric lead merge on Spark: canonical mapping, merge, screening and reports."""
