"""Tables, searches, compaction, indexes and analytics."""
