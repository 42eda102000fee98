"""Query registry over the driver's tables."""
