"""The same expressions on streams."""
