"""PriceLens: a Spark-native engine that compares shop prices with one anchor shop."""
