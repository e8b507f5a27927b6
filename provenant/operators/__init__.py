"""DataFrame operators: frames and settings in, a lazy frame out."""
