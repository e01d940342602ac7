"""Where rows and changes come from."""
