"""Jobs with a command line: each has its work in a function that takes a session."""
