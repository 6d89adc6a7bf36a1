"""Document and table conversion as Spark jobs."""
