"""Sources: tables, word lists, dictionaries and the English preset."""
