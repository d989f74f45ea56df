"""Relational operators: keys, boundaries, ranges, blocks, leaves and inspection."""
