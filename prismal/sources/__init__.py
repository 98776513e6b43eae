"""Reading and writing models, specs, logs and catalogs."""
