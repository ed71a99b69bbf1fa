"""Column functions: unsigned 32-bit hashes, deterministic coins, sizing formulas."""
