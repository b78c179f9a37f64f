"""Web-corpus analytics as DataFrame operators on Spark."""

__version__ = "0.2.0"
