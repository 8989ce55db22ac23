"""streaming of fundtrace."""
