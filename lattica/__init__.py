"""Property-graph and corpus analytics as lazy Spark DataFrame operators."""
