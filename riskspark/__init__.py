"""PySpark-native analytics for text, URL, domain and event-stream risk."""
