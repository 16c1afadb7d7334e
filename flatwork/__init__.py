"""Self-service table analytics as Spark DataFrame operators."""
