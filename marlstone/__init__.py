"""Document and retrieval analytics on PySpark: DataFrame in, DataFrame out."""
