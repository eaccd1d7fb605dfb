"""Sources: the canonical views of the tables, text formats and binary formats."""
