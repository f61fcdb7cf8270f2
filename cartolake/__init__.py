"""A multi-tenant knowledge graph of software systems, and its reports, as Spark jobs over tables."""
