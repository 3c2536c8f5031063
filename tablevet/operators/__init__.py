"""Checks, profiles and rules: each one is a plan over the whole table."""
