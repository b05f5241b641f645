"""PySpark-native factor analytics on long panels of bars."""
