"""Job-listing analytics as PySpark DataFrame operators."""
