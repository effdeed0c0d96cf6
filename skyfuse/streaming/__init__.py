"""Per-image features arriving as files."""
