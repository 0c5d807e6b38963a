"""Analytics over sample-by-feature measurements as Spark DataFrame operators."""
