"""Segmentation of ordered, irregularly spaced measurements into labelled domains, as lazy Spark plans."""
