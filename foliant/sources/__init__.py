"""Reading and writing: files, postings, letters, and what to do with rows that could not be read."""
