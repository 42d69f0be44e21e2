"""Operators of a training-data pipeline: formatting, scoring, deduplication, mixing and packing of text."""
