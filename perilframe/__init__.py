"""Disaster-incident analytics as Spark DataFrame operators."""
