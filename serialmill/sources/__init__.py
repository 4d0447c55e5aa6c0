"""Driver tables bound to the model of the library: series, chapters, cache entries, events, lines."""
