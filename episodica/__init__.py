"""Sensor-journal analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
