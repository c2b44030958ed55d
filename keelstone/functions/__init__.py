"""keelstone functions."""
