"""gridwright.plans."""
