"""Spark-native ontology and knowledge-graph analytics."""
