"""A Spark engine that finds sensitive content in text and video frames and plans its redaction."""
