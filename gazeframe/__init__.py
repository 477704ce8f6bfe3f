"""Behavioural-annotation analytics on Spark: sequences, labels, agreement statistics, resampling, prompts, learning."""
