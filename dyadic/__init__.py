"""dyadic: batch analytics over undirected pair data, declared as Spark plans."""
