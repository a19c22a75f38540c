"""Schema inference, statistics and physical advice."""
