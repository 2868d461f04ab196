"""A PySpark-native engine for data onboarding and reconciliation."""
