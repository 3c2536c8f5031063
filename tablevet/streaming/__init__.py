"""Quality counts of streams."""
