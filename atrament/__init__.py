"""atrament: a PySpark-native engine for transcription data and training-data preparation."""

__version__ = "0.1.0"
