"""Place-scoped situation analytics on PySpark."""
