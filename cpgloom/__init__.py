"""A PySpark engine for feature-by-sample methylation matrices and the data work around them."""
