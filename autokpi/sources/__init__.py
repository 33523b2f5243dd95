"""autokpi.sources."""
