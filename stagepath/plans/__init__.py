"""Multi-step builds and the registered query catalog."""
