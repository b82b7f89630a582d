"""Donor and customer analytics as lazy Spark DataFrame functions."""
