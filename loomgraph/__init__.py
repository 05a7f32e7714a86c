"""Repository-graph and trace analytics as Spark DataFrame jobs."""
