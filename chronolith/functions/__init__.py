"""Part of chronolith."""
