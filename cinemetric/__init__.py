"""cinemetric: text, video-segment and embedding analytics on Spark."""

__version__ = "0.1.0"
