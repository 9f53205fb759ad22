"""The query layer: filter language, field catalog, and queries that turn into DataFrames."""
