"""PySpark-native graph analytics, sequence operators and their sources."""
