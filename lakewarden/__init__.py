"""lakewarden: schema, script and statement review, retrieval and data checks on Spark."""
