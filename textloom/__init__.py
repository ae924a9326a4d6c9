"""textloom: prepare, classify, generate and measure text datasets with Spark."""

__version__ = "0.1.0"
