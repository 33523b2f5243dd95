"""autokpi.operators."""
