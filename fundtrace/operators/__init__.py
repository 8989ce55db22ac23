"""operators of fundtrace."""
