"""Sources, sinks and run control."""
