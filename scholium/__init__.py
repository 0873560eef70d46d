"""scholium: a literature-corpus engine written as Spark DataFrame and streaming jobs."""
