"""tessera: curation and training-data operators expressed as Spark jobs."""
