"""A Spark-native engine for analysing reasoning-search experiments and preparing training text."""
