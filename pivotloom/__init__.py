"""pivotloom: evidence-graph pivots and evidence joins as Spark DataFrame jobs."""
