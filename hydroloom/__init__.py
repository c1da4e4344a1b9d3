"""hydroloom: gridded series, river networks and gauge records as Spark tables."""

__version__ = "0.1.0"
