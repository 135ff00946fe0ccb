"""Strandline: a Spark-native engine for molecular-data analytics and corpus preparation."""
