"""Scene sources and sinks."""
