"""symgraph: symbol graphs, ranked text search and corpus preparation on PySpark."""
