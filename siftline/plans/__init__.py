"""Named queries over the standard tables, each with equivalent SQL where SQL can express it."""
