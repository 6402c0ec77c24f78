"""Plans: detectors, summaries and series models built from the operators, and the queries over the driver's tables."""
