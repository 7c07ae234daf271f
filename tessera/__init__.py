"""tessera: retrieval and knowledge analytics as PySpark DataFrame operators."""
