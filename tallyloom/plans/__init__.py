"""From query text to DataFrame: parsing, rewriting, ordering, planning."""
