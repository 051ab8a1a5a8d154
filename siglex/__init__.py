"""PySpark-native tokenisation and analytics of signal tables."""
