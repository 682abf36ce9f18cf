"""Training-data operators: text, tokens, media, near duplicates and mixing, as Spark jobs."""
