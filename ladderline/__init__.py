"""ladderline: point-in-time analytics over paired contests, expressed as Spark plans."""

__version__ = "0.1.0"
