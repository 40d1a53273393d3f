"""Readers that turn files, urls, databases and Spark tables into the schema model."""
