"""Spark-native analytics for confusable terms in speech transcripts."""
