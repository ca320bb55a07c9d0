"""Literature and corpus analytics on PySpark."""
