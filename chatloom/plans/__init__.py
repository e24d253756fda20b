"""Named queries over the table directory and their SQL counterparts."""
