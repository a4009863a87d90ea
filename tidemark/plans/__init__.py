"""Plans of tidemark."""
