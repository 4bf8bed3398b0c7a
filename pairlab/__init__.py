"""pairlab: a PySpark-native engine for statistical-arbitrage research tables."""
