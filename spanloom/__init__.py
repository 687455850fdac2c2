"""Text-span analytics on Spark: a library of DataFrame-to-DataFrame operators."""

__version__ = "0.1.0"
