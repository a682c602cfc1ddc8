"""Sources: repositories, parsers, commit logs and symbol indexes."""
