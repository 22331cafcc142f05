"""gridwright.functions."""
