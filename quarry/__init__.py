"""Text retrieval, memory, graph and corpus analytics as Spark DataFrame operators."""
