"""DataFrame-to-DataFrame operators, grouped by the kind of rows they work on."""
