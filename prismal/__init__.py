"""Design-independent conceptual queries on Spark."""
