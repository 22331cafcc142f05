"""gridwright.operators."""
