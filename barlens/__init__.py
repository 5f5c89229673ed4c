"""Bar, factor and trade analytics expressed as Spark DataFrame operators."""
