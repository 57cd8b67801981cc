"""Column functions and naming rules."""
