"""Plans: model fitting and prediction, fixtures over the data folder, named queries, command line."""
