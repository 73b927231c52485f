"""What is planned in Python before Catalyst: predicates, the index ladder, admission."""
