"""foliospark: structure checks, reads and ranked search over Markdown corpora on Spark."""

__version__ = "0.1.0"
