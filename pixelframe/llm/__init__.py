"""Training-data operators; nothing outside this subpackage imports it."""
