"""Product-page analytics on Spark: captured pages in, typed marketplace tables out."""
