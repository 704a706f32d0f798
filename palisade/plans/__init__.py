"""Plan-time work: the pattern language and its compilation to regular expressions."""
