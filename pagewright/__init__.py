"""Document-quality analytics and training-data operators on PySpark."""
