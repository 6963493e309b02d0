"""Point-in-time analytics on PySpark: DataFrame in, DataFrame out."""
