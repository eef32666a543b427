"""Signal analytics over ordered, labelled feature tables, written as Spark jobs."""
