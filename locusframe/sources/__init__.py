"""Files read and written."""
