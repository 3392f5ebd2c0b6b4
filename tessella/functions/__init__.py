"""See README.md for the contents."""
