"""functions of fundtrace."""
