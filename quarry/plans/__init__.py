"""From request paths to logical plans."""
