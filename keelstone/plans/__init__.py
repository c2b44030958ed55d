"""keelstone plans."""
