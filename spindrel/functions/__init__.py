"""Column expressions: vector arithmetic, bit packing, text preparation."""
