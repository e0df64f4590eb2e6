"""PySpark-native engine for indexes of dated listings from semi-structured sources."""
