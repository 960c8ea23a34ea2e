"""PySpark-native engine for restructuring and auditing positioned text at scale."""
