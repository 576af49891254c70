"""Log analytics on PySpark."""
