"""autokpi.sinks."""
