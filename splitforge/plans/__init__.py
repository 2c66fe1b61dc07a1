"""Named end-to-end plans over the given tables, with equivalent SQL."""
