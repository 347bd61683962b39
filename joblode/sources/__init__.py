"""Tables, stage files and crawl addresses."""
