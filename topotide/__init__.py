"""topotide: geo-temporal topic analytics as Spark DataFrame operators."""
