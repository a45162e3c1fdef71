"""Where records come from: directories, driver tables, reports, caches."""
