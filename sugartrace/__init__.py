"""Glucose, insulin and carbohydrate analytics as Spark DataFrame operators."""
