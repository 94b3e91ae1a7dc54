"""Spark-native analytics for document corpora: transcription metrics, layout and entity scoring, corpus assembly."""

__version__ = "0.1.0"
