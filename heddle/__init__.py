"""heddle: code and document intelligence analytics as PySpark DataFrame operators."""
