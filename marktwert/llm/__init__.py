"""Training-data operators (documents, pages, conversations) as Spark jobs."""
