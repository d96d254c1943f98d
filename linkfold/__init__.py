"""Entity resolution and retrieval analytics as PySpark DataFrame plans."""
