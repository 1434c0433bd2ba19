"""siteloom: web-harvest analytics expressed as Spark DataFrame plans."""
