"""Repository analytics and corpus preparation on PySpark."""
