"""Spark-native audit of spreadsheet cash-flow models."""
