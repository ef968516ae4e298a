"""Text and XML sinks."""
