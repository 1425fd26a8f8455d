"""The library's operators on the stand-in tables, each with the SQL that says the same."""
