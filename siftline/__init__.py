"""Spark-native analytics over model output, agent traces and training corpora."""
