"""keelstone operators."""
