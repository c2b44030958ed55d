"""keelstone streaming."""
