"""Spark-native analytics for versioned records, event logs and conversational text."""
