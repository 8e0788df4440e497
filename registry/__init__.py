"""Every operator on the driver tables, next to equivalent SQL."""
