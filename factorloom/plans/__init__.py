"""Named queries: one per operator, with the SQL each is checked against."""
