"""Inspection-planning and text-corpus analytics as Spark DataFrame operators."""
