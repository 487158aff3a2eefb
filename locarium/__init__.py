"""locarium: a PySpark-native engine for place directories."""
