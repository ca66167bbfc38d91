"""Reading tables, null vocabularies and typing, writing results."""
