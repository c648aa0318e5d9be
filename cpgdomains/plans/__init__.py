"""Whole pipelines, configuration, registered queries."""
