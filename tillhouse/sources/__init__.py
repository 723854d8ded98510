"""Where tables are read from and published to."""
