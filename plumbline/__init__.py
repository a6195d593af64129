"""Plumbline: data-quality analytics for event streams, written for Spark."""
