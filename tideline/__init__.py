"""tideline: event-timeline, container and media analytics on PySpark."""

__version__ = "0.1.0"
