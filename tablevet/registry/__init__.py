"""The queries checked against SQL, and that SQL."""
