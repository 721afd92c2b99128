"""semspark: a PySpark-native engine for semantic analytics over business tables and SQL logs."""
