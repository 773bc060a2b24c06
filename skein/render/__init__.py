"""Text renderings of bounded results."""
