"""gridwright.streaming."""
