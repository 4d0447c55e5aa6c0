"""Spark jobs over large libraries of serial fiction."""
