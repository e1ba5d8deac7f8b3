"""RDF terms, solution values and filter expressions as Spark columns."""
