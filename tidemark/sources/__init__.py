"""Sources of tidemark."""
