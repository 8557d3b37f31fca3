"""Match-history analytics on Spark: odds cohorts, similarity search and schedule patterns."""
