"""Corpuscule: a PySpark-native engine for turning raw document corpora into clean, auditable tables."""
