"""Part of the tristage engine."""
