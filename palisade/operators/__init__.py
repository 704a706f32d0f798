"""Operators on documents: matching, interval filters and censoring."""
