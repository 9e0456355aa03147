"""Part of gatewise."""
