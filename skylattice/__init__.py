"""Trajectory and airspace analytics as Spark DataFrame programs."""
