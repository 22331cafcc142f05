"""gridwright.sources."""
