"""tidemark: interval, timeline, box and metric analytics as Spark DataFrame functions."""
