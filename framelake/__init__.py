"""Framelake: a PySpark-native engine for searching moments in video archives."""
