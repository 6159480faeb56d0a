"""tessera: evidence-graph and corpus analytics on PySpark."""
