"""quern: record linkage and analytics as Spark DataFrame operators."""
