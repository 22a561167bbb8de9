"""Survey, geospatial and data-quality analytics as Spark DataFrame plans."""
