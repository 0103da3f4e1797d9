"""Schema-state and data-change analytics on PySpark."""
