"""Batch jobs that outline, check and score whole corpora of long documents on Spark."""
