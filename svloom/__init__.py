"""Spark-native analysis of structural variants, and operators for training data."""
