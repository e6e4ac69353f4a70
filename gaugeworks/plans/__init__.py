"""Named queries over the driver tables, with equivalent SQL, and the domain plans."""
