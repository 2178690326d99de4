"""Part of plexivec."""
