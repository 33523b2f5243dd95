"""autokpi.streaming."""
