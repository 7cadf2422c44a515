"""Slot-demand and discount analytics as Spark DataFrame transformations."""
