"""quarrymeter: Spark-first measurement analytics over repositories and text corpora."""
