"""Event-log and identity analytics as PySpark DataFrame operators."""
