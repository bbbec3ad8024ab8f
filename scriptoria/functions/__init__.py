"""Part of scriptoria."""
