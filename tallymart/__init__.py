"""tallymart: commerce analytics as PySpark DataFrame operators."""
