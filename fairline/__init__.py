"""fairline: temporal market analytics as Spark DataFrame operators."""
