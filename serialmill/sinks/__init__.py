"""What the library writes: files for each chapter or series, and versioned snapshots."""
