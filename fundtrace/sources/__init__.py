"""sources of fundtrace."""
