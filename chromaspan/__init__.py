"""Copy-number analytics as Spark DataFrame plans."""
