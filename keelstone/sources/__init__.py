"""keelstone sources."""
