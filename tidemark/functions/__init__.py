"""Column-level helpers: trading calendar, exact rounding, symbol lookup, size-checked joins."""
