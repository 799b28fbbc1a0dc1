"""Plans: registered queries on the supplied tables, each with an independent SQL form."""
