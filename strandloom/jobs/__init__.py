"""Jobs: whole mapping flows composed of the operators, and their options."""
