"""tallyloom: batches of select-project-equi-join-sum queries, planned Spark-first."""
