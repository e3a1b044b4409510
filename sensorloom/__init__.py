"""Windowed-sensor analytics and language-model evaluation as Spark plans."""
