"""Configuration, registries and plug-in points."""
