"""Column expressions: addressed draws, scenario algebra, classifications."""
