"""Content-hash catalog analytics on PySpark."""
