"""Column functions: pure ``Column -> Column`` builders, no actions."""
