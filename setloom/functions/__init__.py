"""Part of setloom."""
