"""autokpi.plans."""
