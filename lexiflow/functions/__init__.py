"""Column functions: strings and scripts, controlled vocabularies, scheduling arithmetic."""
