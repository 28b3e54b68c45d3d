"""Spark-native engine for clinical case tables and the classifiers built on them."""
