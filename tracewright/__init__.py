"""Spark-native analytics for event logs, SQL evaluation, corpus metrics and paired statistics."""
