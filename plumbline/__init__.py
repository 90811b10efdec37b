"""plumbline: a PySpark-native verification, change-analytics and text-corpus engine."""
