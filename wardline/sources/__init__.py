"""Sources of the moderation engine."""
