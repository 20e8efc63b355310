"""Document reconciliation on Spark: every stage of a document set, as DataFrames."""
