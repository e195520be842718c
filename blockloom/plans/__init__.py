"""Composite operators: whole encoders, choosers and experiment plans."""
