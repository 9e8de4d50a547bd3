"""The same tables fed by document streams."""
