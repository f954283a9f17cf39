"""Derived-state auditing on Spark: decode, validate, order, fold, compare, explain."""
