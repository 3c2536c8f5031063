"""Whole-table scoring and the views on its result."""
