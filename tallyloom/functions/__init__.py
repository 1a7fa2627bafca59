"""functions of tallyloom."""
