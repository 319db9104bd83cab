"""modelbom: AI bill-of-materials analytics as Spark DataFrame operators."""
