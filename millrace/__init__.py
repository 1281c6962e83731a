"""millrace: a Spark-native analytics library (DataFrame / SQL / Structured Streaming)."""
