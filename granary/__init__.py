"""granary: a Spark-native engine for producing, validating and measuring text datasets."""

__version__ = "0.1.0"
