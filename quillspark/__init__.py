"""Knowledge-corpus retrieval and curation as Spark jobs."""
