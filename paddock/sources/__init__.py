"""Reading raw pages, JSON and tables; writing results."""
