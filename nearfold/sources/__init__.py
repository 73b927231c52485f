"""Reading and writing: fixtures, segments, uploads, reports, generated corpora."""
