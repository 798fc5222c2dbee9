"""Column functions over names and contents."""
