"""harrow: a PySpark-native engine for company contact discovery over collected web content."""
